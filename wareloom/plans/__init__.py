"""Whole runs: operators put together over stored state."""
