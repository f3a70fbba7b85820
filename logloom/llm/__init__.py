"""Operators for preparing training data, one module each; ``registry`` holds their queries and SQL."""
