"""Operators for large training corpora: licences, tokens, similarity, packing and media.

Nothing else in the library imports this subpackage.
"""
