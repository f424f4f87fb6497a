"""Functions of photo-session tables."""
