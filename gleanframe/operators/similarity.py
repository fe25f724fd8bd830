"""Similarity operators: exact twins, duplicate tests, label and reference matching, duplicate graphs of picks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.functions.scalars import similarity_bonus
from gleanframe.session import col


def exact_twins(rows: DataFrame, item: str, digest: str, score: str, within: Sequence[str] = ()) -> DataFrame:
    """``item, keeper, twins`` for every row: the best of the rows with the same digest (highest score, then smallest item) stands for all.

    A NULL or empty digest is no one's twin. One aggregate and one join: a digest shared by very many rows is combined map-side.
    """
    key = F.coalesce(F.nullif(col(digest), F.lit("")), F.concat(F.lit("\0"), col(item)))
    base = rows.select(*[col(k).alias(f"w{i}") for i, k in enumerate(within)], col(item).alias("item"), key.alias("key"), col(score).cast("double").alias("score")).where("item IS NOT NULL").distinct()
    w = [f"w{i}" for i in range(len(within))]
    order = F.struct(F.when(F.isnan("score"), None).otherwise(F.col("score")).isNull().alias("none"), (-F.col("score")).alias("low"), F.col("item"))
    best = base.groupBy(*w, "key").agg(F.min(order)["item"].alias("keeper"), F.count("*").alias("twins"))
    on = [F.col(f"w{i}").eqNullSafe(F.col(f"b{i}")) for i in range(len(w))] + [F.col("key") == F.col("bkey")]
    best = best.select(*[F.col(x).alias(f"b{i}") for i, x in enumerate(w)], F.col("key").alias("bkey"), "keeper", "twins")
    return base.join(best, on).select(*[F.col(x).alias(k) for x, k in zip(w, within)], F.col("item").alias(item), "keeper", "twins")


def classify(rows: DataFrame, item: str, vector: str, labels: DataFrame, label_vector: str, scale: float = 100.0) -> DataFrame:
    """``item, idx, label, label_prob, people_prob``: softmax over the cosine to every label's vector, the first best label.

    ``labels`` (idx, label, is_people, vector) is a vocabulary, checked to hold at most 10,000; rows meet it in one matrix product a batch.
    Rows without a vector of its length have no row.
    """
    found = labels.select("idx", "label", "is_people", col(label_vector).alias("v")).orderBy("idx").limit(10_001).collect()
    if len(found) > 10_000:
        raise ValueError("a label vocabulary above 10,000 rows needs a join, not a broadcast")
    kind = dict(rows.dtypes)[item]
    table = np.array([r["v"] for r in found], dtype=np.float64).reshape(len(found), -1)
    people = np.array([bool(r["is_people"]) for r in found], dtype=bool)
    sent = rows.sparkSession.sparkContext.broadcast((table, people, [int(r["idx"]) for r in found], [r["label"] for r in found]))

    def run(batches):
        table, people, idx, names = sent.value
        for b in batches:
            ids, v = b.column(0), b.column(1)
            lengths = np.where(v.is_valid().to_numpy(zero_copy_only=False), np.diff(v.offsets.to_numpy()), -1)
            good = pa.array(lengths == table.shape[1])
            x = v.filter(good).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, max(table.shape[1], 1))
            if not len(x) or not len(names):
                continue
            s = x @ table.T
            w = np.exp(scale * (s - s.max(1, keepdims=True)))
            at, total = s.argmax(1), w.sum(1)
            yield pa.RecordBatch.from_arrays(
                [ids.filter(good), pa.array(np.array(idx)[at].astype(np.int32)), pa.array([names[i] for i in at], pa.string()), pa.array(w[np.arange(len(at)), at] / total), pa.array(w[:, people].sum(1) / total)],
                ["item", "idx", "label", "label_prob", "people_prob"],
            )

    out = rows.select(col(item).alias("item"), col(vector).alias("x")).mapInArrow(run, f"item {kind}, idx int, label string, label_prob double, people_prob double")
    return out.withColumnRenamed("item", item)


def reference_bonus(rows: DataFrame, item: str, vector: str, reference: np.ndarray, weight: float = 0.5) -> DataFrame:
    """``item, best, bonus``: the highest cosine to a stated reference set, mapped to a bounded bonus; blocks of rows against the set."""
    sent = rows.sparkSession.sparkContext.broadcast(np.asarray(reference, dtype=np.float64))
    kind = dict(rows.dtypes)[item]

    def run(batches):
        for b in batches:
            ok = b.v.map(lambda x: x is not None and len(x) == sent.value.shape[1])
            best = np.full(len(b), np.nan)
            if ok.any() and len(sent.value):
                best[ok.to_numpy()] = (np.stack(b.v[ok].to_numpy()).astype(np.float64) @ sent.value.T).max(1)
            yield pd.DataFrame({"item": b.item, "best": best})

    out = rows.select(col(item).alias("item"), col(vector).alias("v")).mapInPandas(run, f"item {kind}, best double")
    best = F.when(F.isnan("best"), None).otherwise(F.col("best"))
    return out.select(F.col("item").alias(item), best.alias("best"), F.coalesce(similarity_bonus(best, weight), F.lit(0.0)).alias("bonus"))


def best_match(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rn") -> DataFrame:
    """The first row of each key in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(out, F.row_number().over(w)).where(F.col(out) == 1).drop(out)
