"""Spark jobs that turn business tables into a linked, searchable, ranked corpus."""
