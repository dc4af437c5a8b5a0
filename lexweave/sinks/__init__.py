"""Sinks of the dictionary engine."""
