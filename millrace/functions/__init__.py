"""Column functions: array mathematics, text scoring and checks."""
