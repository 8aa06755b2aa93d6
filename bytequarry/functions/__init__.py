"""Scalar functions: byte kernels, ladders, strings, checksums, transforms and codecs."""
