"""Spark operators for the data side of large-scale batch model inference."""
