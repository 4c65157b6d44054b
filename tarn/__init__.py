"""Sparse retrieval and text-corpus processing as PySpark DataFrame plans."""
