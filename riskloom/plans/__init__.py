"""Composite pipelines and the registered query catalog."""
