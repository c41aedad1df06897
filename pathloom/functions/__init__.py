"""Scalar, array and matrix functions."""
