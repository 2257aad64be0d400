"""Readers and writers: benchmark folders, vector tables, caches and results."""
