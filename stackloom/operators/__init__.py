"""Operators on document, chunk and ledger tables."""
