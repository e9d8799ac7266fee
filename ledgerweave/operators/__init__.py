"""Operators on typed tables, quads and edges."""
