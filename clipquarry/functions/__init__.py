"""Column-level rules: no joins, no shuffles."""
