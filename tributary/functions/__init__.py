"""Scalar functions as Column expressions, and the fixed word lists they look things up in."""
