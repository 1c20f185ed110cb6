"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  ``registry`` lists its
queries and their SQL; ``__spark_entry__`` adds them only when it is present.
"""
