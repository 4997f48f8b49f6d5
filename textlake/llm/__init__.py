"""Operators that prepare text for training language models. Nothing else of the library imports this package."""
