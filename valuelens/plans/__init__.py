"""Registered queries over the driver's test tables and their DuckDB oracles."""
