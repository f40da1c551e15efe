"""Queries over the given tables, with the SQL they are checked against."""
