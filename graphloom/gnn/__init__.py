"""Graph neural networks: numpy kernels for one task, DataFrame message passing for large graphs."""
