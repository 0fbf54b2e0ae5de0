"""Column expressions, lineage control and the NumPy kernels that grouped tasks run."""
