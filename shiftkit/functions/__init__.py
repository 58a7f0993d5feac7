"""Column expressions and distributed ranks that the operators share."""
