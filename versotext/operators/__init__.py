"""Relational operators over content tables."""
