"""Column expressions: text cleaning, vectors, formatting."""
