"""Continuous maintenance of crawl state."""
