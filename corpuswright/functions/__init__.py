"""Column-level functions (Column in, Column out)."""
