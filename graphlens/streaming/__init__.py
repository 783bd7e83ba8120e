"""Incremental refresh of a graph."""
