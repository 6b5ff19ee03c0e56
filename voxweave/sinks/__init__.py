"""Writers: meshes, trajectories, matrices, deformation graphs, images."""
