"""Model calls as a pluggable step: a client answers prompts in batches; the default one answers by hash, offline."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class ModelClient(Protocol):
    def answer(self, prompts: list[str]) -> list[str]: ...


class HashClient:
    """One letter of A to D for each prompt, by its hash."""

    def answer(self, prompts: list[str]) -> list[str]:
        return ["ABCD"[int(md5(p.encode()).hexdigest()[:4], 16) % 4] for p in prompts]


def ask(df: DataFrame, prompt: str, out: str = "reply", client: Callable[[], ModelClient] = HashClient, tries: int = 3) -> DataFrame:
    """df with the client's reply to each prompt.  A worker makes its client once; a batch that fails is asked again, and after the last
    try its replies are null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = client()
        for frame in batches:
            replies: list[str | None] = [None] * len(frame)
            for left in reversed(range(tries)):
                try:
                    replies = list(model.answer(frame[prompt].fillna("").tolist()))
                    break
                except Exception:  # noqa: BLE001 - a model may fail in any way; the last failure leaves nulls
                    if not left:
                        break
            frame[out] = replies
            yield frame

    from pyspark.sql import types as T

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))
