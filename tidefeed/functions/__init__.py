"""Functions of tidefeed."""
