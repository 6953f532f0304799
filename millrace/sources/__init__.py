"""Scans, schemas, configuration and metadata sources."""
