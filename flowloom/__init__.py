"""flowloom: flow maps of programs, and their aggregates, as Spark plans."""
