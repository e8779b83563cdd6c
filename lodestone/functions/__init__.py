"""Column expressions, and the small per-document helpers behind the Arrow functions."""
