"""Operators for preparing training data: tokenizing, filtering, de-duplicating, searching and packing."""
