"""Corpus ingest, hybrid retrieval, evaluation and batch text tasks as Spark jobs."""
