"""Operators over node, edge, version and log tables."""
