"""Registered queries: fixtures, plans and their SQL."""
