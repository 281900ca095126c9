"""Operators for preparing training text and matching records. Nothing else in the library imports this."""
