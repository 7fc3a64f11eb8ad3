"""Lectern: text and provenance analytics on Spark DataFrames."""
