"""Operators over DataFrames of posts, labels and pages."""
