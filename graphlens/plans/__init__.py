"""Graph projection of the relational tables, query catalogue and SQL counterparts."""
