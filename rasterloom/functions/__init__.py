"""Column builders for intensities, matrices and names."""
