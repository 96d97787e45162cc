"""Point, voxel and frame-sequence analytics as plain DataFrame transforms."""
