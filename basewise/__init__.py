"""Positional count analytics as Spark jobs: tables in, DataFrames out."""
