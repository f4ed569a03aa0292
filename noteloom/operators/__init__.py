"""Operators from frame to frame: indexes, search, stores, maintenance."""
