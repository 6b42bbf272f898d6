"""Batch and streaming Spark jobs for retrieval over notes, documents and source code."""
