"""Retail, trip and warehouse analytics as plain Spark DataFrame functions."""
