"""Derived views and the query catalogue."""
