"""Readers, writers and adapters to the line and unit tables."""
