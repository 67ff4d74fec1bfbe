"""Readers, writers and content digests."""
