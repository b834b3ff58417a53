"""Column expressions: binning, projection and hex lattice, cell typing, size checks."""
