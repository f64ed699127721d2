"""The analyses and ingest jobs: DataFrames in, DataFrames out."""
