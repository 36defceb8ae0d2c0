"""Operators for large language-model training data. Nothing outside this package imports it."""
