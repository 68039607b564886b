"""Composed plans: the query catalogue, its DuckDB oracles and feature pipelines."""
