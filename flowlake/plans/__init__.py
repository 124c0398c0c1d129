"""Iterative and multi-step jobs over DataFrames."""
