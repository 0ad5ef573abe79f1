"""Retail and service analytics as plain functions from DataFrames to a DataFrame."""

__version__ = "0.1.0"
