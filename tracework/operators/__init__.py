"""Operators over interval event logs, each a function from DataFrames to a DataFrame."""
