"""Spark jobs for code and text retrieval and for training-data pipelines."""
