"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it. ``registry.QUERIES`` and ``registry.ORACLE_SQL`` hold
its queries.
"""
