"""Sources of the dictionary engine."""
