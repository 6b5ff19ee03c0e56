"""Readers: frame folders, trajectories, meshes, configuration, generated lattices."""
