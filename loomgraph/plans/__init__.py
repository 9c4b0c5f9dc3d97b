"""Iterative analytics and the query catalogue."""
