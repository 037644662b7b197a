"""Readers and writers: Parquet, CSV, nested order JSON, text and JSON reports."""
