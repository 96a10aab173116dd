"""Column helpers built from Spark's own functions."""
