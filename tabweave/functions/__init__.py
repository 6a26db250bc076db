"""Column functions: pure expressions, no actions, usable in batch and streaming queries."""
