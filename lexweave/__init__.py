"""Lexweave: dictionary and corpus processing on Spark DataFrames."""
