"""Column expressions: line patterns, timestamps, JSON fields, numbers and tokens."""
