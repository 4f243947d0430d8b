"""Operators for building training corpora, and their named queries."""
