"""Readers and writers of graphs and source files."""
