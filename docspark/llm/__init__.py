"""Operators for training-data corpora, with their queries and the SQL beside them."""
