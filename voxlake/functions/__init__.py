"""Column expressions and short parameter notations."""
