"""The operators: DataFrames of canonical rows in, lazy DataFrames out."""
