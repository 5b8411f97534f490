"""Operators for preparing large training corpora (see entries.py for the queries)."""
