"""Column expressions on series, vectors, dates and JSON."""
