"""Column-level functions: expressions, scalars, filters, random values and metrics."""
