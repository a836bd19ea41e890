"""Detectors: each reads a DataFrame and returns findings."""
