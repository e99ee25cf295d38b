"""Readers and normalisers that turn landed files and feeds into model tables."""
