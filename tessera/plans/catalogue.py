"""Registered queries of the reference's operators, each with DuckDB SQL for the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "q01_which_first"

#: The event and entity views of sources.adapters in SQL.
EV = """ev AS (SELECT event_id, event_type AS activity, 'C' || CAST(user_id % 8 AS VARCHAR) AS camera_id, user_id AS actor_id,
 strftime(ts, '%Y-%m-%d') AS slot, (epoch_us(ts) % 86400000000) // 1000 AS start_ms,
 (epoch_us(ts) % 86400000000) // 1000 + CAST(floor(least(value, 30.0) * 1000) AS BIGINT) AS end_ms FROM events)"""
EN = EV + """, en AS (SELECT slot, camera_id, actor_id, min(start_ms) AS first_ms, max(end_ms) AS last_ms, count(*) AS n_events FROM ev GROUP BY ALL)"""


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


from . import aggregates, driving, evaluation, files, questions, render, slots, spatial, temporal, texts, validation, words  # noqa: E402, F401
