"""Column expressions: text, amounts, names and addresses."""
