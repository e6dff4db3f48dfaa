"""Operators for training text: entity matching, encoding, mixing and shared spans. Nothing else in the package imports it."""
