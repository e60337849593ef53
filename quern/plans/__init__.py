"""Declared query plans."""
