"""Column functions: text, routes, packages, and the heuristics of rules."""
