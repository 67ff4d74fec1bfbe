"""Column functions: arithmetic, arrays, vectors, text."""
