"""Operators over tables: ranking, lookups, text search, change capture, batching and parsing."""
