"""Interval, sequence and score-track analytics on Spark DataFrames."""
