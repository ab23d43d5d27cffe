"""Terralith: territorial observability and separability analytics on Spark."""
