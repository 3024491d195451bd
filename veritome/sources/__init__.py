"""Readers and writers: page files, the ingest cache, runs and their records, final tables."""
