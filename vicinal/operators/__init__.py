"""Operators over points (id, features) and edges (src, dst, ...) tables."""
