"""Streams of points through fitted models."""
