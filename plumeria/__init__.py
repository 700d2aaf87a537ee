"""Recommender analytics on Spark DataFrames."""
