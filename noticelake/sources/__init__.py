"""Scans, sinks, the raw payload archive and the parse job."""
