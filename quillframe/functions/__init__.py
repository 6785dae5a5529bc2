"""Column expressions: text, arrays, geometry."""
