"""Operators for preparing training data: one module each, and ``queries`` with their registered forms."""
