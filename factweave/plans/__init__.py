"""Reusable plan patterns: cutting lineage, size-checked joins, picks with a total order, fixpoints."""
