"""Scoring specifications and the steps that combine operators."""
