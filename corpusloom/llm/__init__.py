"""Operators for language-model training text; nothing else in the package imports this."""
