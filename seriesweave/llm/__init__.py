"""Operators for preparing training data: mixing, packing, cleaning, search and output."""
