"""DataFrame-in, DataFrame-out steps of the segment pipeline."""
