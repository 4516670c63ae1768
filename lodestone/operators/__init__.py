"""Operators over files, chunks, vectors and sessions."""
