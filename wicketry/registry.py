"""All queries of the library and the SQL that checks them."""

from __future__ import annotations

from .plans import career_queries, file_queries, impact_queries, innings_queries, job_queries, match_queries, player_queries
from .plans.fixture import tables

MODULES = (career_queries, match_queries, innings_queries, player_queries, impact_queries, job_queries, file_queries)


def _found() -> dict:
    return {name: pair for m in MODULES for name, pair in m.build().items()}


def queries():
    return {name: (lambda spark, sf_dir, f=f: f(tables(spark, sf_dir))) for name, (f, _) in _found().items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _found().items() if sql}
