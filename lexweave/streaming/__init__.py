"""Streaming of the dictionary engine."""
