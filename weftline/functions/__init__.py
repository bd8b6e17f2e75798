"""Column expressions and block-algebra helpers."""
