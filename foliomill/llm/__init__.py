"""Operators for preparing text corpora for language-model training.

Nothing outside this subpackage imports it; ``queries.py`` registers one query
per operator and ``__spark_entry__.py`` adds them when the package is present.
"""
