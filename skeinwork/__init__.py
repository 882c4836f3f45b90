"""Skeinwork: an analytics engine for dynamic graphs on Spark DataFrames."""
