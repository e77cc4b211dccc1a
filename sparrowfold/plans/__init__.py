"""Whole flows, and the registry of queries."""
