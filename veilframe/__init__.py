"""Sensitive-data analytics as Spark DataFrame operators."""
