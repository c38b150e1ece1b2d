"""Cadenza: a music-library analytics and recommendation engine on Spark DataFrames."""
