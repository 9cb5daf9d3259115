"""Plans of the phonetic matching library."""
