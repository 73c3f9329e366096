"""Quillmill: document preparation and retrieval on Spark DataFrames."""
