"""Segmentation analytics on Spark: keyed tables of voxels in, scorecards and comparisons out."""
