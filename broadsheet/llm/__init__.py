"""Operators for text corpora that feed language models. Nothing outside this package imports it."""
