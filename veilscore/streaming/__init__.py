"""Structured Streaming entry points for the stateless scoring operators."""
