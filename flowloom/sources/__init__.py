"""Where facts, rules and settings come from, and where documents go."""
