"""Tables that are written and read again: shelves of captured bodies, and the versioned store."""
