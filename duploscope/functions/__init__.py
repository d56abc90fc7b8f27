"""Column functions; all of them are built from Spark's own expressions."""
