"""Spark-first analytics over captured web catalogues and text corpora."""
