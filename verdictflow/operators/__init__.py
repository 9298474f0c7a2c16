"""Operators over whole tables: DataFrames in, DataFrames out."""
