"""Column expressions: text, attributes, quality, pages and URLs."""
