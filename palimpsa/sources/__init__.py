"""Readers and writers: snapshots of record tables, texts and binary sources."""
