"""Scans (landing, silver, feature store, CSV) and sinks (partitioned writes, merges)."""
