"""Verify of the dictionary engine."""
