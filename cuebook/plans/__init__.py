"""cuebook.plans."""
