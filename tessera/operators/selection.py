"""Order-dependent greedy selection within a slot: a fold over candidates in a total order."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def greedy(candidates: DataFrame, keys: list[str], order: list[str], take: Callable[[dict, dict], bool]) -> DataFrame:
    """The candidates of each key that take(state, row) accepts, in the given order; take may change the state.

    A key's candidates are one group, so the keys must bound it (a run of events, the best candidates of a slot)."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        state: dict = defaultdict(set)
        rows = frame.sort_values(order, kind="stable")
        return rows[[take(state, r) for r in rows.to_dict("records")]]

    return candidates.groupBy(*keys).applyInPandas(fold, candidates.schema)


def no_reuse(*groups: tuple[str, ...]) -> Callable[[dict, dict], bool]:
    """Rows no value of which was used before in a column of the same group."""

    def take(state: dict, row: dict) -> bool:
        if any(row[c] in state[g] for g in groups for c in g):
            return False
        for g in groups:
            state[g].update(row[c] for c in g)
        return True

    return take


def at_most(n: int, *columns: str) -> Callable[[dict, dict], bool]:
    """Rows whose value in each column was taken fewer than n times."""

    def take(state: dict, row: dict) -> bool:
        counts = state.setdefault("counts", defaultdict(int))
        if any(counts[c, row[c]] >= n for c in columns):
            return False
        for c in columns:
            counts[c, row[c]] += 1
        return True

    return take


def bucket_pick(candidates: DataFrame, keys: list[str], count: int) -> DataFrame:
    """count candidates of each key (h: hash order; key: what may be taken once; proximity; crosses): crossing ones first, then one
    of each proximity, then others."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        rows, taken, seen = frame.sort_values("h").to_dict("records"), [], set()

        def take(some: list[dict], most: int) -> None:
            for r in some:
                if most <= 0 or len(taken) >= count:
                    return
                if r["key"] not in seen:
                    seen.add(r["key"])
                    taken.append(r)
                    most -= 1

        take([r for r in rows if r["crosses"]], count)
        for bucket in ("near", "moderate", "far"):
            take([r for r in rows if r["proximity"] == bucket], 1)
        take(rows, count)
        return pd.DataFrame(taken, columns=frame.columns)

    return candidates.groupBy(*keys).applyInPandas(fold, candidates.schema)
