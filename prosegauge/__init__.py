"""Spark-native scoring of short written posts, and operators around it."""
