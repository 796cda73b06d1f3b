"""Column functions: complex and uncertain numbers, scalars, arrays, windows, tags, expressions, sentences."""
