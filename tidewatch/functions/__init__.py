"""Column expressions: scores, texts and p-values."""
