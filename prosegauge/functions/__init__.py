"""Scalar building blocks: word lists and text primitives as Column expressions."""
