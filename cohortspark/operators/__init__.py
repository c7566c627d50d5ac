"""Operators over long measurement tables."""
