"""Sources of tidefeed."""
