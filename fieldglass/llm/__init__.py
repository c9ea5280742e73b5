"""Operators for preparing training text: filters, deduplication, extraction, packing.

Input may have any further columns; names that start with two underscores are theirs alone.
"""
