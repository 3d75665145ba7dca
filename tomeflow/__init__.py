"""Spark-first engine for document-knowledge pipelines."""
