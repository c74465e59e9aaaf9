"""Reading and storing article tables."""
