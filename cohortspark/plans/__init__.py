"""Whole-cohort pipelines."""
