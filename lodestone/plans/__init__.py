"""Compositions: retrieval plans, the registered queries and their SQL."""
