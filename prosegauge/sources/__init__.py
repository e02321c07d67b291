"""Stores: labels as JSON lines, verdicts by post and scorer version."""
