"""Clustering, feature preparation, sampling, generation and run-log operators."""
