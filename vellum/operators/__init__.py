"""Operators over argument tables, nested records and run metrics."""
