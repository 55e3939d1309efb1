"""Column-expression builders (no Python on the executors)."""
