"""Scans and sinks: web archives and message sequences."""
