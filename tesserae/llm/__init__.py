"""Operators of training-data preparation. Nothing outside this subpackage imports it."""
