"""Operators for building language-model training corpora.

Each module holds one operator with its own general interface; ``queries.py`` registers the
thin queries over the given tables.  Nothing outside this subpackage imports it.
"""
