"""Operators over findings and code graphs, each a function from DataFrames to a DataFrame."""
