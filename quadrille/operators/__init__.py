"""Operators on cell and rectangle tables."""
