"""Registered queries over the sample tables and their DuckDB counterparts."""
