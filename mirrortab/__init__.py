"""Synthetic tables on Spark: prepare, split, generate, repair and judge tabular data."""
