"""Operators for preparing training text; see queries.py for their bound forms."""
