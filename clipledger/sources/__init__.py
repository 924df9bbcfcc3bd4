"""Readers, adapter views and key-value stores kept as Parquet."""
