"""Column expressions: loss terms, slopes, link functions."""
