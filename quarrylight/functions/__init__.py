"""Column expressions: text units, identities, paths and globs."""
