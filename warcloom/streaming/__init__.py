"""Structured Streaming over arriving archive files."""
