"""Compositions: path to path stages, and the mapping of the driver tables."""
