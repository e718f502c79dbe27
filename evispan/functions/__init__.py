"""Column expressions and segmenting."""
