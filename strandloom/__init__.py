"""Sequence, annotation and genomic-interval analytics on Spark DataFrames."""
