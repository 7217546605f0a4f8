"""Spreadsheet-to-answer analytics on Spark."""
