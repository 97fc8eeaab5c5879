"""DataFrame operators: normalise, type, profile, rows, impute, encode, scale."""
