"""Composite queries: whole reports from operators."""
