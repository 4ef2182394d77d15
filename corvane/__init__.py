"""Batch document retrieval, ranking evaluation and corpus auditing on Spark DataFrames."""
