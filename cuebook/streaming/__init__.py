"""cuebook.streaming."""
