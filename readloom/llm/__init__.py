"""Corpus operators for preparing language-model training data.

Nothing else in ``readloom`` imports this subpackage, so it can be removed whole.
"""
