"""Column profiles and value checks."""
