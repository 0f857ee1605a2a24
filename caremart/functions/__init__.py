"""Column-level helpers: null-safe arithmetic, exact quantiles, modes, p-values."""
