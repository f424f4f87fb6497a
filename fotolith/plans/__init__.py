"""Plans of photo-session tables."""
