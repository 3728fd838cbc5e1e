"""DataFrame-in, DataFrame-out operators on the dealership tables."""
