"""Structured Streaming forms of watching a source tree."""
