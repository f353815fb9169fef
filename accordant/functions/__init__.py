"""Column functions: no joins, no actions."""
