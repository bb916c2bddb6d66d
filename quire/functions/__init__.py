"""Column functions: native Spark expressions, no Python in the tasks."""
