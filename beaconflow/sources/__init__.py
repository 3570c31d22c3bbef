"""Readers, schema contracts and writers."""
