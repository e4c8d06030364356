"""Scalar functions of the lineage engine as Column expressions."""
