"""Palimpsest: text-reuse and authorship analytics as PySpark DataFrame pipelines."""
