"""Operators for preparing training text: filters, duplicate search, classifiers, token counts."""
