"""Readers that write fact tables."""
