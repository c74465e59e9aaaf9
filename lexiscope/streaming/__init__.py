"""Categorising articles as they arrive."""
