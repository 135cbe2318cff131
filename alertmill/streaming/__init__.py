"""Incremental runs: resume, progress, expiry."""
