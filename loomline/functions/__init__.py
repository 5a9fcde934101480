"""Column expressions: text, hashes and categories."""
