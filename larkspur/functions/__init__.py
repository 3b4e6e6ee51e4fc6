"""Scalar functions: expressions, parsing, the embedded language."""
