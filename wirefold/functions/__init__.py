"""Column-level functions and rules."""
