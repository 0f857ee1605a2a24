"""Query plans: the registered queries, their DuckDB oracles, reports and the model."""
