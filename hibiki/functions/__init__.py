"""Functions of the phonetic matching library."""
