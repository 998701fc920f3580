"""Readers, snapshot normalisers and table writers."""
