"""Operators for preparing training text at scale; nothing else in foliospark imports this package."""
