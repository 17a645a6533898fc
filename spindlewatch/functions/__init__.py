"""Statistics that need more than one built-in function."""
