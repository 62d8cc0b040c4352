"""Corpus retrieval and record-quality jobs on Spark DataFrames."""
