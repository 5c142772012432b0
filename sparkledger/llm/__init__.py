"""Operators for preparing training text: mixing, near-duplicate joins, filters, scans and encodings."""
