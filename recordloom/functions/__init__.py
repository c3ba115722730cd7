"""Part of recordloom."""
