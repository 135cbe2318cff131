"""Readers and writers: alert formats, dependency scans, run folders, label logs, registries, code facts."""
