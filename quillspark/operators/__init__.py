"""Operators: one module for each family."""
