"""Distributed operators: statistics, moments, ridge/CG, k-means, NMI,
SVD and random feature maps."""
from . import blocks, features, kmeans, moments, nmi, ridge, stats, svd  # noqa: F401
