"""Operators for preparing training data, each with a registered query."""
