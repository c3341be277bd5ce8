"""Readers, writers, and adapters from the sample tables."""
