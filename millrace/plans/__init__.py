"""Size checks, shared scratch storage and the registered table queries."""
