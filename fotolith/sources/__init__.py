"""Sources of photo-session tables."""
