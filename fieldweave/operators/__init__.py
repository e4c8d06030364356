"""Operators of the lineage engine and their registered queries."""
