"""Whole queries built of the operators."""
