"""Column expressions: text, tokens, extraction, similarity."""
