"""Operators of a training-data pipeline over the ``documents`` and ``embeddings``
tables.  Nothing outside this package imports it; ``queries.py`` lists its queries."""
