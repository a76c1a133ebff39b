"""Column expressions and p-values."""
