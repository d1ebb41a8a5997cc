"""Recommendation jobs written as plain Spark DataFrame transformations."""
