"""Retrieval operators over DataFrames; edge tables, not matrices, pass between them."""
