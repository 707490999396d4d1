"""Skew-safe building blocks shared by all operators."""
