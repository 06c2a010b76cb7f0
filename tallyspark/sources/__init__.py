"""Readers and writers of event streams and count traces."""
