"""Queries: the competency questions, their projection of the driver's tables, and the catalogue."""
