"""Column functions; all of them are native expressions except the t-distribution."""
