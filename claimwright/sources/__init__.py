"""Readers and writers: tables, files, markdown extracts, caches and reports."""
