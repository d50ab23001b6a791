"""Declared derivations, and how results become a verdict."""
