"""Vectors: neighbours, clusters, encoders."""
