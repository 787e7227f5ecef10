"""Depth-series analytics for wells, as Spark DataFrame operators."""
