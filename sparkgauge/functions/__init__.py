"""Column functions: normalization of messy fields, text and JSON helpers."""
