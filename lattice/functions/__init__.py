"""Scalar text, path and key functions as Column expressions."""
