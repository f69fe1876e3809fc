"""Physical patterns shared by the operators: skew splits, positions, blocks."""
