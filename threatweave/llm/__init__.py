"""Operators for preparing training data, and the queries that show them."""
