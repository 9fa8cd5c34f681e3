"""Readers, writers and table specifications."""
