"""Command-output analytics on Spark DataFrames."""
