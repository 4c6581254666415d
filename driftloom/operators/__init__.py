"""Operators over feature tables and condition records."""
