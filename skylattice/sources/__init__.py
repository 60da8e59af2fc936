"""Sources of the lattice engine."""
