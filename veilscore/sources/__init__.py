"""Scans, sinks and model files."""
