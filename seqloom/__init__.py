"""Exact and approximate string search as Spark jobs."""
