"""Operators over event tables: queries, groups, windows, lookups, statistics, state tables and result tables."""
