"""Scalar functions and statistical helpers."""
