"""Structured Streaming forms of collection and scoring."""
