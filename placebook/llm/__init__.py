"""Operators for training text: duplicates, languages, tokens, windows, pages.

Nothing else in the library imports this package.
"""
