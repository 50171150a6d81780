"""DataFrame operators: neighbours, affinities, kernels, updates, cells, multiple maps, metrics."""
