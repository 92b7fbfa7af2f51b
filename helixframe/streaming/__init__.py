"""Structured Streaming forms of corpus preparation and training-log roll-up."""
