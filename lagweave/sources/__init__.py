"""Scans, conforming, and sinks."""
