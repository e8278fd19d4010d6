"""Continuous publication of extraction results."""
