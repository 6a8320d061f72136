"""Spreadsheet structure analytics on Spark."""
