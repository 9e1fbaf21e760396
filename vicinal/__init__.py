"""Neighbour graphs, low-dimensional embeddings and vector quantization over Spark DataFrames."""
