"""Spreadsheet functions as columns."""
