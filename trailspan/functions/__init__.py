"""Column functions: names, geometry, hashing."""
