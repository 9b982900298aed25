"""cuebook.operators."""
