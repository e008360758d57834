"""Operators for preparing text corpora: fingerprints, duplicates, personal data, licences, tokens, mixing, search.

Nothing else in the library imports this subpackage.
"""
