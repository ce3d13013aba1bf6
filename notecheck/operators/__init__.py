"""DataFrame operators: joins, windows, aggregates, rules."""
