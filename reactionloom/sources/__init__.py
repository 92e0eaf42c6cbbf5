"""Scans: driver tables, model files, drawn maps and lookups."""
