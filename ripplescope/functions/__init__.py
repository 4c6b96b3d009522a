"""Column expressions: paths, texts, numbers."""
