"""Incremental search over a query stream, an addition to the batch operators."""
