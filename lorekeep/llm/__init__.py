"""Operators for preparing training corpora; see queries.py for the registered queries."""
