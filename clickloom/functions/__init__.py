"""Column functions: everything here stays inside Spark's expression engine."""
