"""Streaming of tidefeed."""
