"""Multilingual passage retrieval, evaluation and export as Spark plans."""
