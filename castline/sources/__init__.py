"""Readers of level parts, indexes, profile documents, arrays, snapshots and region records."""
