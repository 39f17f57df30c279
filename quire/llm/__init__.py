"""Operators that prepare text for training language models, and the queries that apply them."""
