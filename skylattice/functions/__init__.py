"""Functions of the lattice engine."""
