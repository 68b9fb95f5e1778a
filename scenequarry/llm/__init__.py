"""Operators for preparing training text: quality, near-duplicates, extraction, mixing, filters and scans.

Nothing else in the package imports this subpackage.
"""
