"""Scalar and vector functions: Column expressions for the JVM, numpy kernels for Arrow batches."""
