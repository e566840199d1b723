"""All registered queries."""

from __future__ import annotations

from featurelab.plans import encoding, genetic, grids, preparation, profiling, scoring, temporal_queries

AREAS = [preparation, profiling, temporal_queries, encoding, genetic, scoring, grids]


def all_queries() -> dict:
    return {name: query for area in AREAS for name, query in area.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for area in AREAS for name, sql in area.ORACLE.items()}
