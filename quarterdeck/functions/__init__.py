"""Column functions: periods, numbers, labels."""
