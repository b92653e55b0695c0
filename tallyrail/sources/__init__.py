"""Table readers and report writers."""
