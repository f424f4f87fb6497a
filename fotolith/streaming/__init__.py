"""Streaming of photo-session tables."""
