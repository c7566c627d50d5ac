"""Scoring measurements as they arrive."""
