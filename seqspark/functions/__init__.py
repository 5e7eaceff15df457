"""Column functions: key slots, key checks and byte sizes."""
