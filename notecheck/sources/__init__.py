"""Readers and writers of the tables."""
