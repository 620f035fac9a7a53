"""Operators over span, node, edge and graph tables."""
