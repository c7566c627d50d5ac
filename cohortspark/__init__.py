"""Normative cohort scoring on Spark."""
