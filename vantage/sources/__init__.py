"""Readers and writers of feature tables, manifests, graphs and pair lists."""
