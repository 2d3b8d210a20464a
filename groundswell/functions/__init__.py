"""Column expressions: area codes, safe numbers, display values."""
