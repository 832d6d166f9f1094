"""Operators for preparing training text: deduplication, filtering, encoding, scoring.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
