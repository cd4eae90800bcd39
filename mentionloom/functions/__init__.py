"""Column functions: names, markup, string similarity, scores."""
