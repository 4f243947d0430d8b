"""Readers, sinks, materialised extracts and the bindings to given tables."""
