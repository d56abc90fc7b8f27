"""Find and resolve redundancy in large tables of items with Spark DataFrames."""

__version__ = "0.1.0"
