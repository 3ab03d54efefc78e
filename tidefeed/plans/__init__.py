"""Plans of tidefeed."""
