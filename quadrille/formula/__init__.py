"""Formulas: parsing, evaluation, generalisation."""
