"""Column functions: text, dates, vectors, JSON."""
