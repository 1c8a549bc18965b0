"""Chunked, seekable compression and analytics over compressed data, as Spark plans."""
