"""Snapshot-exact code and document analytics on Spark DataFrames."""
