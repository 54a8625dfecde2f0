"""Data-platform analytics as functions over Spark DataFrames."""
