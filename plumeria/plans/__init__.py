"""End-to-end analytics plans."""
