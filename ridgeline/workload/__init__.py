"""Registered queries (Spark) and their DuckDB oracle SQL, on the shared test tables."""
