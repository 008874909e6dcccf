"""Systematic-review and meta-analysis engine on Spark DataFrames."""
