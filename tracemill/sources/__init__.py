"""Scans, sinks and the views that map source tables onto the record model."""
