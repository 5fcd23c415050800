"""Operators for preparing language-model training data, and the queries that apply them to whole tables.

Nothing else in ``netweave`` imports this subpackage.
"""
