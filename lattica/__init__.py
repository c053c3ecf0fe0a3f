"""Grouped-set analytics on Spark."""
