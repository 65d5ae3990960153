"""Part of heatlattice."""
