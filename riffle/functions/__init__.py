"""Column functions: time, numbers, labels."""
