"""Graphs of documents that arrive in batches."""
