"""Corpus ingestion, vector retrieval and conversation analytics as Spark jobs."""
