"""Operators on change logs and target tables."""
