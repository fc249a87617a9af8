"""Part of the cohort engine."""
