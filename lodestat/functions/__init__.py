"""Column-level functions: text, URL, numbers, dates, hashing."""
