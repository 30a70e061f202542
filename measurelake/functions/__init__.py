"""Column expressions and DataFrame building blocks."""
