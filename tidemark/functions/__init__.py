"""Column expressions for subjects, paths, identities and texts."""
