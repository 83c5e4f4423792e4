"""Registered queries, their SQL, and helpers that shape plans."""
