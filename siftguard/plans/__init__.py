"""Whole scans assembled from operators."""
