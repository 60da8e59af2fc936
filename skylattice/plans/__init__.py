"""Plans of the lattice engine."""
