"""Whole pipelines, and the named queries over the driver's tables."""
