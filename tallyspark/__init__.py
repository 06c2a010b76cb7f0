"""Certified heavy hitters over windowed, partitioned event streams, as Spark plans."""
