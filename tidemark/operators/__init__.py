"""Operators over bar DataFrames."""
