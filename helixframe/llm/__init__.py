"""Operators on text corpora for training data; nothing outside this package imports it."""
