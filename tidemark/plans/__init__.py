"""Whole reports, the read-only SQL surface and threshold checks."""
