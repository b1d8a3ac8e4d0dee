"""Operators for preparing large text corpora.

Nothing outside this subpackage imports it; ``queries.py`` in this folder
registers its queries with ``__spark_entry__`` when the folder is present.
"""
