"""Column expressions: text, vectors, time."""
