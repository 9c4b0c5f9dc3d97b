"""Adjacency, profiles, updates and message passing."""
