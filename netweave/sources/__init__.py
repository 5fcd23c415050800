"""Readers of group files, and shared intermediate tables."""
