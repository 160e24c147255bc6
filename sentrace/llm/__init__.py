"""Operators for preparing training text: filters, duplicate removal, search, packing."""
