"""Column functions: hashing, Unicode text, metrics, geometry, identifiers."""
