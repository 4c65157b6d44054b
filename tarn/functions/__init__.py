"""Scalar functions of retrieval: tokenizers, stemmers, stop words and scores, as column expressions where Spark has them."""
