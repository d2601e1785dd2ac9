"""Structured Streaming forms of keyed folds."""
