"""Retrieval and analytics over collections of source files and documents, on Spark."""
