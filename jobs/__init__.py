"""Runnable jobs over note collections."""
