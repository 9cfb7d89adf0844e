"""Operators for building training corpora from web-scale text.

Nothing outside this subpackage imports it; ``queries`` registers its entry
points with the repository's driver contract.
"""
