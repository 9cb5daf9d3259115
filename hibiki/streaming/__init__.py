"""Streaming of the phonetic matching library."""
