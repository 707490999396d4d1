"""Flows that chain operators; every stage is a table in and a table out."""
