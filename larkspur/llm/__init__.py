"""Operators for language-model training text and statistics.

Nothing outside this subpackage imports it; it may be removed as a whole.
"""
