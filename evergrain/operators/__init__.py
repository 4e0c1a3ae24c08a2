"""Relational operators over evidence: each takes and returns DataFrames and leaves the physical plan to Spark."""
