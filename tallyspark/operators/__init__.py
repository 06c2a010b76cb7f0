"""Operators over event streams, counts, local reports and results."""
