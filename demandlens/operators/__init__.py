"""DataFrame operators: aggregates, temporal fills and comparisons, event attribution,
statistics and ranks, rule tables, audits and joins. Each takes and returns DataFrames."""
