"""Column functions: vectors and paths."""
