"""Relational, statistical, linkage, vector and model operators."""
