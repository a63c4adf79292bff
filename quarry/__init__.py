"""Ranked text search and corpus preparation on Spark."""
