"""Operators for large training-data pipelines over a documents table."""
