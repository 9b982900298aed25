"""cuebook.sources."""
