"""Operators over snapshots, layers, blobs, trees, images, operation logs and access events.

All take and return DataFrames and have no side effects on the session."""
