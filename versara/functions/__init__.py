"""Column expressions and pure functions."""
