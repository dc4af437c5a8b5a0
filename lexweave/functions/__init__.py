"""Functions of the dictionary engine."""
