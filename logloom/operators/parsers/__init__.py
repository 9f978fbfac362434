"""Parsers: Columns from a raw line to a parsed struct."""
