"""DataFrame operators: projection, mapping, lookups, history, relations, quality, changes."""
