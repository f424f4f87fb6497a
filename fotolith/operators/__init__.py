"""Operators of photo-session tables."""
