"""Span analytics and text curation on PySpark."""
