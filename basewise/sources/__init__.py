"""Readers: parquet tables and the line formats that feed them."""
