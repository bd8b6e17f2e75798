"""Composed jobs, and the registry of queries over the given tables."""
