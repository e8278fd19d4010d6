"""Column functions: text, URL and JSON values."""
