"""Operators for training data: frequent items, packing, mixing, residue. Nothing else imports this package."""
