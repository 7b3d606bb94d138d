"""Readers: the given parquet tables, fixture views derived from them, raw text and JSON."""
