"""Readers, writers and table definitions."""
