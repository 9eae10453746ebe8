"""Column expressions and injected model functions."""
