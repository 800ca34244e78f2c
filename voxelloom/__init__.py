"""voxelloom: sparse-voxel analytics for particle trajectories on Spark."""

__version__ = "0.1.0"
