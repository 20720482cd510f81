"""Column expressions and small per-row helpers."""
