"""Operators over matrices, networks, groups and hierarchies."""
