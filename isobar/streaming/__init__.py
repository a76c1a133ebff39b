"""Structured Streaming forms of calendar means and sessions."""
