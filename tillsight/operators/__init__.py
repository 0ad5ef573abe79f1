"""The analyses. Every function takes DataFrames and parameters and returns a DataFrame."""
