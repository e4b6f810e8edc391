"""Relational operators of the reference graph. All take and return DataFrames."""
