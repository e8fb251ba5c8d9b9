"""Functions that several operators share: ranks and quantiles over ranges of values, distances on the ground."""
