"""Operators for training data and for statistics over very large columns."""
