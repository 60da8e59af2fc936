"""Streaming of the lattice engine."""
