"""Snapshot, layer, image and access-log analytics as Spark DataFrames."""
