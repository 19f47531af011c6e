"""DataFrame operators. `repo` may be skewed everywhere: no operator brings all rows of a
repo into one task or one value, unless their number or size is bounded."""
