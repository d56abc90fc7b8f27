"""Whole jobs over the given tables."""
