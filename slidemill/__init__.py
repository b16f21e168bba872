"""Slide tile engine: whole-slide containers, pyramids and tiles as Spark relations."""
