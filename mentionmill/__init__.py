"""Coreference analytics on Spark DataFrames: pairs, scores, clusters, metrics."""
