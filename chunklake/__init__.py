"""Snapshots, semantic diffs, patches, merges and history over tables and voxel worlds, on Spark."""
