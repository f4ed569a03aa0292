"""Readers of notes, JSON lines and index files."""
