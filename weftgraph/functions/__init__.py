"""Column functions and small helpers of the graph engine."""
