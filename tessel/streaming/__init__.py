"""Structured Streaming over the tile directory."""
