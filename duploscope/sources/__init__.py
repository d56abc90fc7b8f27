"""Inventories from tables, files and images."""
