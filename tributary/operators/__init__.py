"""Relational operators of record fusion, over DataFrames of evidence."""
