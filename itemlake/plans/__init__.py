"""Whole jobs: documents to bank rows, requests to papers, and the registered queries."""
