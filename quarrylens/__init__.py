"""Deterministic data profiling and evidence packets on Spark DataFrames."""
