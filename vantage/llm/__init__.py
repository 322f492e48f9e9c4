"""Training-data operators: scoring, search, cleaning, packing and sharding of text corpora."""
