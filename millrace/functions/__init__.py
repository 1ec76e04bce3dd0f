"""Column functions: vectors, signed hashing, position-addressed uniforms."""
