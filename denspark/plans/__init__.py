"""Whole computations: clustering, the estimator, metrics."""
