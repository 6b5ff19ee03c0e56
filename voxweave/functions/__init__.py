"""Column-level maths: vectors, matrices, quaternions, camera model, kernels."""
