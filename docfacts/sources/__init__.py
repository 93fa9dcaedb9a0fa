"""Scans of documents and listings, lookup tables, and content-addressed preservation."""
