"""Relational operators over evidence records, pages and candidates."""
