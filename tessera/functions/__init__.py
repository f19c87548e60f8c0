"""Column functions (text, vectors, parameters, SQL text)."""
