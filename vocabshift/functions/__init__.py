"""Column and aggregate helpers built from Spark built-in functions."""
