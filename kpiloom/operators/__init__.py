"""Operators composed from DataFrame primitives."""
