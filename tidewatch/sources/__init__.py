"""Scans, payload parsing, stores and sinks."""
