"""Numpy kernels: distances, clustering, quantizers and graphs."""
