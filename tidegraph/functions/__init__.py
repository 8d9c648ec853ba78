"""Scalar functions: each takes columns and gives a column."""
