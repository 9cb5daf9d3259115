"""Operators of the phonetic matching library."""
