"""Operators that are more than a Spark SQL text."""
