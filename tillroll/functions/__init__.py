"""Column-level helpers: schema normalisation, coercions, rounding, ranking."""
