"""Fixed values that results must agree with, as plain tables."""
