"""Versara: versioned, hierarchically addressed text corpora as Spark DataFrames."""
