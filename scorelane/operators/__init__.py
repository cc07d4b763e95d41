"""Operators over DataFrames; each returns a DataFrame and leaves planning to Spark."""
