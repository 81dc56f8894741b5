"""Relational operators over DataFrames and the store."""
