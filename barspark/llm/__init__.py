"""Operators for preparing training text: scoring, sharding, mixing, deduplication and secret scans.

Nothing outside this subpackage imports it.
"""
