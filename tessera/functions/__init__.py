"""Scalar and column functions."""
