"""Crawl analytics over captured responses, expressed as Spark DataFrame operators."""
