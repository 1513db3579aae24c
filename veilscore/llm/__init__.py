"""Operators and queries for preparing large text corpora (training data)."""
