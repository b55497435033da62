"""Tidemark: document, table and retrieval analytics expressed as Spark plans."""
