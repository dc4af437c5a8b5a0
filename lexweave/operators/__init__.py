"""Operators of the dictionary engine."""
