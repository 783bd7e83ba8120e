"""Graph operators: traversals, audits, health, rules, diffs and search."""
