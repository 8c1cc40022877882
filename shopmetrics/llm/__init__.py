"""Operators for preparing text corpora, embeddings and conversations."""
