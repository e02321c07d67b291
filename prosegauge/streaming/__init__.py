"""Structured Streaming: discovery events, retries, emit-once."""
