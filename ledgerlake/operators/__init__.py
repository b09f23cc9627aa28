"""Data operators: DataFrames in, DataFrames out."""
