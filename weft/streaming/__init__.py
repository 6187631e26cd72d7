"""Streams of change and metric rows."""
