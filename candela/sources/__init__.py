"""Where bars and quotes come from."""
