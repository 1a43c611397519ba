"""Column expressions and skew-safe relational building blocks."""
