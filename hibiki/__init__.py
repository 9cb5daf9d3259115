"""Phonetic matching of kana text on Spark."""
