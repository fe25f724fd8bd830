"""Sequence clustering: scenes, moments and bursts of items in the order of time.

The rules compare each item with the running centroid of its sequence, so they are folds: the result of one row depends on all before.
A pause above the gap always ends a sequence, so the rows of a key first fall into independent segments (``operators.sessions``, many
tasks per key). Rows are sorted inside their partitions and folded batch by batch as they come, with the running centroid alone in memory,
so a segment may be of any length. Rows without a time stand last in their key and go on from its last segment.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.operators.sessions import mark_sessions
from gleanframe.session import col


def _unit(v) -> np.ndarray | None:
    if v is None:
        return None
    x = np.asarray(v, dtype=np.float64)
    if not len(x) or not np.isfinite(x).all():
        return None
    n = np.linalg.norm(x)
    return x / n if n > 0 else None


class Centroid:
    """Running mean direction of unit vectors; unknown vectors neither count nor differ."""

    def __init__(self) -> None:
        self.total: np.ndarray | None = None

    def similarity(self, v: np.ndarray | None) -> float | None:
        if v is None or self.total is None or len(v) != len(self.total):
            return None
        n = math.sqrt(self.total @ self.total)
        return float(v @ self.total) / n if n > 0 else None

    def add(self, v: np.ndarray | None) -> None:
        if v is not None:
            self.total = v.copy() if self.total is None else self.total + v


class SceneFold:
    """A pause above ``gap`` since the last known time, or a cosine to the running centroid below ``similarity``, opens a scene."""

    names = ("inside int",)

    def __init__(self, gap: float, similarity: float) -> None:
        self.gap, self.similarity = gap, similarity
        self.scene, self.last, self.centre = -1, None, Centroid()

    def step(self, t, scene, v, u) -> tuple:
        s = self.centre.similarity(v)
        if self.scene < 0 or (t is not None and self.last is not None and t - self.last > self.gap) or (s is not None and s < self.similarity):
            self.scene, self.centre = self.scene + 1, Centroid()
        self.centre.add(v)
        self.last = t if t is not None else self.last
        return (self.scene,)


class MomentFold:
    """Finer than scenes: also a change of scene opens a moment, the smaller of whole and subject similarity counts, and after a row without
    time no pause is seen. The novelty of a moment, which all its rows carry, is ``(1 - similarity) / 2`` of its first row against the
    sequence before, 0 at the start and where nothing can be compared."""

    names = ("inside int", "novelty double")

    def __init__(self, gap: float, similarity: float) -> None:
        self.gap, self.similarity = gap, similarity
        self.moment, self.last, self.before, self.novelty = -1, None, None, 0.0
        self.whole, self.part = Centroid(), Centroid()

    def step(self, t, scene, v, u) -> tuple:
        known = [s for s in (self.whole.similarity(v), self.part.similarity(u)) if s is not None]
        s = min(known) if known else None
        if self.moment < 0 or scene != self.before or (t is not None and self.last is not None and t - self.last > self.gap) or (s is not None and s < self.similarity):
            self.novelty = 0.0 if self.moment < 0 or s is None else (1 - max(-1.0, min(1.0, s))) / 2
            self.moment, self.whole, self.part = self.moment + 1, Centroid(), Centroid()
        self.whole.add(v), self.part.add(u)
        self.last, self.before = t, scene
        return self.moment, self.novelty


class BurstFold:
    """A pause above ``gap``, ``span`` or more since the burst began, time going back, another scene or a cosine below ``similarity`` opens a
    burst. A row without time is in none (-1) and ends the sequence."""

    names = ("inside int",)

    def __init__(self, gap: float, span: float, similarity: float) -> None:
        self.gap, self.span, self.similarity = gap, span, similarity
        self.burst, self.last, self.began, self.before, self.centre = -1, None, None, None, Centroid()

    def step(self, t, scene, v, u) -> tuple:
        if t is None or not np.isfinite(t):
            self.last = None
            return (-1,)
        s = self.centre.similarity(v) if self.last is not None else None
        if self.last is None or t < self.last or t - self.last > self.gap or t - self.began >= self.span or scene != self.before or (s is not None and s < self.similarity):
            self.burst, self.began, self.centre = self.burst + 1, t, Centroid()
        self.centre.add(v)
        self.last, self.before = t, scene
        return (self.burst,)


def fold(rule, times: Sequence[float | None], vectors: Sequence, scenes: Sequence | None = None, subjects: Sequence | None = None) -> list[tuple]:
    """The rule over rows in order, from lists."""
    n = len(times)
    return [rule.step(t, s, v, u) for t, s, v, u in zip(times, scenes or [0] * n, map(_unit, vectors), map(_unit, subjects or [None] * n))]


def fold_scenes(times, vectors, gap: float, similarity: float) -> list[int]:
    return [x for (x,) in fold(SceneFold(gap, similarity), times, vectors)]


def fold_moments(times, scenes, vectors, subjects, gap: float, similarity: float) -> tuple[list[int], list[float]]:
    out = fold(MomentFold(gap, similarity), times, vectors, scenes, subjects)
    return [i for i, _ in out], [n for _, n in out]


def fold_bursts(times, scenes, vectors, gap: float, span: float, similarity: float) -> list[int]:
    return [x for (x,) in fold(BurstFold(gap, span, similarity), times, vectors, scenes)]


def segments(rows: DataFrame, key: str, time: str, gap_seconds: float) -> DataFrame:
    """The rows with ``segment``: the start (microseconds) of the stretch of the key without a pause above the gap.

    Rows without a time carry the key's last segment, or NULL where no row of the key has a time. Rows without a key are left out.
    """
    marks = mark_sessions(rows, key, time, gap_seconds).select(F.col("key").alias("m_key"), F.col("t").alias("m_t"), F.col("session_t").alias("segment"))
    last = marks.groupBy(F.col("m_key").alias("l_key")).agg(F.max("segment").alias("last_segment"))
    base = rows.where(col(key).isNotNull()).withColumn("m_micros", F.unix_micros(col(time).cast("timestamp")))
    timed = base.where("m_micros IS NOT NULL").join(marks, (col(key) == F.col("m_key")) & (F.col("m_micros") == F.col("m_t"))).drop("m_key", "m_t")
    timeless = base.where("m_micros IS NULL").join(last, col(key) == F.col("l_key"), "left").withColumn("segment", F.col("last_segment")).drop("l_key", "last_segment")
    return timed.unionByName(timeless)


def _numbered(local: DataFrame, key: str, inside: str, out: str) -> DataFrame:
    """Numbers that go on through the segments of a key: one small row per segment carries the count before it."""
    counts = local.groupBy(col(key).alias("c_key"), F.col("segment").alias("c_segment")).agg((F.max(inside) + 1).alias("c_n"))
    w = Window.partitionBy("c_key").orderBy(F.col("c_segment").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("c_before", F.coalesce(F.sum("c_n").over(w), F.lit(0))).drop("c_n")
    joined = local.join(counts, (col(key) == F.col("c_key")) & F.col("segment").eqNullSafe(F.col("c_segment")))
    return joined.withColumn(out, F.when(F.col(inside) >= 0, (F.col(inside) + F.col("c_before")).cast("int")).otherwise(-1)).drop("c_key", "c_segment", "c_before", inside)


def _units(column: pa.Array) -> list:
    """Unit vectors of a list column as rows of one matrix, None where there is none: NULL, empty, not finite or all zero."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = column.offsets.to_numpy() - column.offsets[0].as_py()
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
    out: list = [None] * len(column)
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        x = values[at[rows][:, None] + np.arange(d)]
        norm = np.linalg.norm(x, axis=1)
        good = np.isfinite(norm) & (norm > 0)
        x[good] /= norm[good, None]
        for i, r in enumerate(rows):
            if good[i]:
                out[r] = x[i]
    return out


def _fold(rows: DataFrame, key: str, tie: Sequence[str], time: str, gap: float, make, vector: str, scene: str | None = None, subject: str | None = None) -> DataFrame:
    cut = segments(rows, key, time, gap)
    names = [*[f.name for f in rows.schema], "segment", "m_micros"]
    ddl = ", ".join(f"`{n}` {t}" for n, t in cut.select(*[col(n) for n in names]).dtypes)
    fields = make().names
    # a whole segment in one partition, in order; the fold reads it in batches
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [col(key), F.col("segment"), F.col("m_micros").asc_nulls_last(), *[col(t) for t in tie]]
    ready = cut.select(*[col(c) for c in names]).repartition(n, col(key), F.col("segment")).sortWithinPartitions(*order)
    at = {c: i for i, c in enumerate(names)}

    def run(batches):
        now, rule = None, None
        for b in batches:
            keys, segs = b.column(at[key]).to_pylist(), b.column(at["segment"]).to_pylist()
            times = [None if m is None else m / 1e6 for m in b.column(at["m_micros"]).to_pylist()]
            vs = _units(b.column(at[vector]))
            us = _units(b.column(at[subject])) if subject else [None] * b.num_rows
            scenes = b.column(at[scene]).to_pylist() if scene else [0] * b.num_rows
            out = []
            for k, g, t, s, v, u in zip(keys, segs, times, scenes, vs, us):
                if (k, g) != now:
                    now, rule = (k, g), make()
                out.append(rule.step(t, s, v, u))
            more = [pa.array([o[i] for o in out], pa.int32() if f.endswith("int") else pa.float64()) for i, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*names, *[f.split()[0] for f in fields]])

    return ready.mapInArrow(run, f"{ddl}, {', '.join(fields)}").drop("m_micros")


def cluster_scenes(rows: DataFrame, key: str, time: str, vector: str, tie: Sequence[str], gap_seconds: float = 120.0, similarity: float = 0.80) -> DataFrame:
    """The rows with ``scene_id``, numbered from 0 in each key; order is time, then ``tie``. Rows without a key are left out."""
    return _numbered(_fold(rows, key, tie, time, gap_seconds, lambda: SceneFold(gap_seconds, similarity), vector), key, "inside", "scene_id").drop("segment")


def cluster_moments(rows: DataFrame, key: str, time: str, scene: str, vector: str, subject: str | None, tie: Sequence[str], gap_seconds: float = 8.0, similarity: float = 0.92) -> DataFrame:
    """The rows with ``moment_id`` and the moment's ``novelty``; order is time, then ``tie``."""
    return _numbered(_fold(rows, key, tie, time, gap_seconds, lambda: MomentFold(gap_seconds, similarity), vector, scene, subject), key, "inside", "moment_id").drop("segment")


def cluster_bursts(rows: DataFrame, key: str, time: str, scene: str, vector: str, tie: Sequence[str], gap_seconds: float = 3.0, span_seconds: float = 12.0, similarity: float = 0.75) -> DataFrame:
    """The rows with ``burst_id``, -1 without a time; order is time, then ``tie``."""
    return _numbered(_fold(rows, key, tie, time, gap_seconds, lambda: BurstFold(gap_seconds, span_seconds, similarity), vector, scene), key, "inside", "burst_id").drop("segment")


def global_ids(rows: DataFrame, key: str, number: str) -> DataFrame:
    """The rows with ``number`` going on from key to key in their order, instead of from 0 in each; one small row a key carries its offset.
    Negative numbers (none) stay."""
    tops = rows.groupBy(col(key).alias("g_key")).agg((F.greatest(F.max(number), F.lit(-1)) + 1).alias("g_n"))
    before = Window.orderBy("g_key").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("g_from", F.coalesce(F.sum("g_n").over(before), F.lit(0)))
    j = rows.join(tops, col(key) == F.col("g_key"))
    return j.withColumn(number, F.when(F.col(number) >= 0, (F.col(number) + F.col("g_from")).cast("int")).otherwise(F.col(number))).drop("g_key", "g_n", "g_from")
