"""Whole plans: the two-snapshot report, and queries that bind the operators to tabular data."""
