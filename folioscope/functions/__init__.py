"""Column expressions and small helpers used by the operators."""
