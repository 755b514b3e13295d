"""Finds and masks sensitive or data-like text in documents, pages and conversations, on Spark."""
