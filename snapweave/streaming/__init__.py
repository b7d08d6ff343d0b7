"""Streams of access events."""
