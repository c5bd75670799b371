"""Whole programs over the operators."""
