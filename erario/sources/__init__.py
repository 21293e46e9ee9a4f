"""Readers and writers: monthly archives, delimited text, files and manifests."""
