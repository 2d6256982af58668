"""Column and join helpers with the source database's semantics."""
