"""Plans of the dictionary engine."""
