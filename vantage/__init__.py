"""Vantage: vector-retrieval analytics expressed as PySpark DataFrame programs."""
