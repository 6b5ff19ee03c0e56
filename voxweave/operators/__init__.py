"""DataFrame-to-DataFrame operators over pixels, voxels, meshes, graphs and systems."""
