"""Column functions: no function here adds a shuffle or a Python worker."""
