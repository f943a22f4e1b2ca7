"""Delivery of results in batches, and queries over streams of files."""
