"""NumPy kernels of one group each; none of them imports Spark."""
