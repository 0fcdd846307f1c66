"""Readers of raw files and registries, and writers."""
