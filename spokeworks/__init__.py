"""Spark jobs for bike- and scooter-share trip analysis."""
