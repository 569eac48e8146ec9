"""Operators by family; each takes and returns DataFrames."""
