"""Operators for preparing language-model training data.

Nothing else in the package imports it; ``queries.QUERIES`` and
``queries.ORACLE_SQL`` are what ``__spark_entry__.py`` adds to the others.
"""
