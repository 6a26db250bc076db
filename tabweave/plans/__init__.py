"""Queries over the provided tables, and the SQL each one is checked against."""
