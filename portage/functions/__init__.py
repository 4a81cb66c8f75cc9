"""Column-level building blocks: predicates, names, SQL literals, rewrite rules."""
