"""Operators on DataFrames, one module a family."""
