"""Whole searches and builds, composed of operators."""
