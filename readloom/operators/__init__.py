"""Operators over hits, pairs, summits, reads and mapped records. Each takes and returns DataFrames and plans nothing by hand."""
