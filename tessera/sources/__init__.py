"""Readers: Parquet tables, delimited lists, and extraction of tables, links and text from page sources."""
