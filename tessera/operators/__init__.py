"""Relational, geometric and applied operators; each takes and returns DataFrames."""
