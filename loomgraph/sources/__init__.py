"""Readers, writers, generators and graphs derived from relational tables."""
