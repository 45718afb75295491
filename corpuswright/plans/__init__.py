"""Bindings to the given tables and the query registry."""
