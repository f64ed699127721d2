"""Reusable DataFrame-to-DataFrame building blocks."""
