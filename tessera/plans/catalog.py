"""All registered queries of the engine's own operators, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        _queries[name] = run
        if sql:
            _sql[name] = sql
        return run

    return register


def load() -> None:
    from tessera.plans import exchange_queries, funnel_queries, graph_queries, lineage_queries, pipeline_queries, report_queries, scalar_queries, summary_queries  # noqa: F401


def queries() -> dict[str, Callable]:
    load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_sql)
