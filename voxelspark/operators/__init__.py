"""DataFrame transforms, one module for each stage of a voxel stream."""
