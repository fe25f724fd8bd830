"""Batched model calls as columns: the model is loaded once per worker process and sees Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from gleanframe.session import col


def apply_model(rows: DataFrame, keys: Sequence[str], inputs: Sequence[str], load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], outputs: str, batch: int = 32) -> DataFrame:
    """``keys`` and ``outputs`` (DDL) of a model over ``inputs``; ``load`` runs once per task and returns the function on a batch.

    A batch on which the model fails is tried row by row; rows that still fail keep their keys, with NULL outputs and the reason in
    ``error``, so one bad row costs no other.
    """
    names = [o.strip().split()[0] for o in outputs.split(",")]
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", {outputs}, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()

        def attempt(part: pd.DataFrame) -> pd.DataFrame:
            try:
                got = model(part[list(inputs)].reset_index(drop=True))
                return got[names].assign(error=None)
            except Exception as e:  # noqa: BLE001
                if len(part) > 1:
                    return pd.concat([attempt(part.iloc[[i]]) for i in range(len(part))], ignore_index=True)
                return pd.DataFrame({**{n: [None] for n in names}, "error": [f"{type(e).__name__}: {e}"[:200]]})

        for b in batches:
            for s in range(0, len(b), batch):
                part = b.iloc[s : s + batch]
                yield pd.concat([part[list(keys)].reset_index(drop=True), attempt(part)], axis=1)

    return rows.select(*[col(c) for c in dict.fromkeys([*keys, *inputs])]).mapInPandas(run, schema)
