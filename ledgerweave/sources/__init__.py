"""Readers, sinks and the snapshot lake."""
