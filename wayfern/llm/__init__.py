"""Operators for large text corpora.

Nothing outside this package imports it; ``queries.py`` holds the registered
queries and ``corpus_pipeline.py`` at the repository top chains five of them.
"""
