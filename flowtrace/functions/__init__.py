"""Column functions and constants that the operators share."""
