"""Move graphs, rules and the queries of two-player games."""
