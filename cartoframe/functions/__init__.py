"""Column expressions: geometry, parsing, classification."""
