"""Numerical kernels."""
