"""Operators of tidefeed."""
