"""Operators for preparing training data, each a Spark job over whole tables.

Nothing outside this subpackage imports it.  ``queries.py`` holds the registered queries and ``ORACLE_SQL``.
"""
