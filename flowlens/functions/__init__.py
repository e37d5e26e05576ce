"""Column helpers and statistics."""
