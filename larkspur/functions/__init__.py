"""Column builders: each returns an expression and touches no data."""
