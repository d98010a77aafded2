"""Whole pipelines, test documents, and the registered queries."""
