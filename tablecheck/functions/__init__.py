"""Column-level building blocks: SQL text, types, regular expressions, predicates."""
