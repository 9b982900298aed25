"""cuebook.functions."""
