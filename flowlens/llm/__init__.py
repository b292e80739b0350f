"""Operators for building training corpora out of whole document tables."""
