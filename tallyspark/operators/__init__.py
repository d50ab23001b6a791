"""Relational operators that derivations are made of."""
