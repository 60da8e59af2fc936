"""Operators of the lattice engine."""
