"""Where scenes come from."""
