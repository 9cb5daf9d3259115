"""Sources of the phonetic matching library."""
