"""Column expressions and small DataFrame functions."""
