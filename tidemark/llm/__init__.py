"""Operators for preparing language-model training data.

Nothing else in :mod:`tidemark` imports this subpackage; it can be removed whole.
"""
