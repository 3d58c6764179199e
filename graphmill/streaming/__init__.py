"""Micro-batch ingest of news."""
