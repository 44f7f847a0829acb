"""Operators over arbitrary tables: rules, thresholds and column names are parameters."""
