"""Column functions: names, types and texts of API surfaces."""
