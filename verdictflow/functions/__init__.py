"""Column builders: scalar semantics as Catalyst expressions."""
