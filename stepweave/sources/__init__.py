"""Readers and sinks: gzip CSV, parquet, JSON and JSON lines."""
