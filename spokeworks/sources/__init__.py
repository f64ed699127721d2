"""Readers of raw drops and snapshots, and table reads and writes."""
