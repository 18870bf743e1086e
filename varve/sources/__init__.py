"""Readers and writers of count matrices and stage tables."""
