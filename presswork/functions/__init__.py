"""Column expressions: everything that needs one row only."""
