"""Blended recommendations and interaction analytics as Spark jobs."""
