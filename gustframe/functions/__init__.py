"""Column-level expressions (no Python in the row path)."""
