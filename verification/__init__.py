"""Checks of the engine against DuckDB on the given tables."""
