"""Distributed k-means on unit vectors with parallel oversampled seeding, and the vector columns it works on.

Vectors are a dense column, scaled to length one, optionally followed by hashed features: each categorical column adds its weight with a
hashed sign at a hashed place. Seeding draws, in a few passes, about ``oversample * k`` candidates with a chance in proportion to their
squared distance from the candidates so far, weights them by the rows nearest to them, and reduces them to ``k`` on the driver; a few
Lloyd passes follow, over a sample or over all rows. Only centroids, candidates, sums of a bounded number of partitions and, over all rows,
one sum a centroid ever reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.session import col, materialize

PARTS = 16


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one, scaled first by their largest value so that neither huge nor tiny values leave the range of the squares."""
    peak = np.abs(x).max(1, initial=0)
    scaled = x / np.where(peak > 0, peak, 1)[:, None]
    norm = np.sqrt((scaled.astype(np.float64) ** 2).sum(1))
    return (scaled / np.where(norm > 0, norm, 1)[:, None]).astype(np.float32)


def raw_matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as float32, and which rows are valid: of ``dims`` finite values, not all zero. Others are zero rows."""
    n = len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()), 0)
    good = lengths == dims
    out = np.zeros((n, dims), dtype=np.float32)
    if good.any():
        flat = column.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
        out[good] = flat.reshape(-1, dims)
    finite = np.isfinite(out).all(1)
    out[~finite] = 0
    return out, good & finite & out.any(1)


def matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`raw_matrix`, at length one."""
    x, good = raw_matrix(column, dims)
    return unit(x), good


def hashed(batch: Mapping[str, pa.Array], weights: Mapping[str, float], dims: int) -> np.ndarray:
    """Hashed features of categorical columns: ``weights[c]`` times a hashed sign at a hashed place; NULL adds nothing."""
    n = len(next(iter(batch.values())))
    out = np.zeros((n, dims), dtype=np.float32)
    for c, w in weights.items():
        codes = pd.Series(batch[c].to_pandas())
        for value, rows in codes.groupby(codes).groups.items():
            h = zlib.crc32(f"{c}={value}".encode())
            out[np.asarray(rows), (h >> 1) % dims] += w if h & 1 else -w
    return out


def to_bytes(x: np.ndarray) -> pa.Array:
    """float32 rows as binary values with equal bytes side by side: lossless, and far smaller once compressed."""
    n, d = x.shape
    raw = np.ascontiguousarray(np.ascontiguousarray(x, dtype="<f4").view(np.uint8).reshape(n, d, 4).transpose(0, 2, 1)).tobytes()
    offsets = np.arange(n + 1, dtype=np.int32) * (4 * d)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def from_bytes(column) -> np.ndarray:
    values = column.to_pylist() if not isinstance(column, (list, pd.Series, np.ndarray)) else list(column)
    if not values:
        return np.zeros((0, 0), dtype=np.float32)
    d = len(values[0]) // 4
    raw = np.frombuffer(b"".join(values), dtype=np.uint8).reshape(len(values), 4, d)
    return np.ascontiguousarray(raw.transpose(0, 2, 1)).reshape(len(values), 4 * d).view("<f4").astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]).astype(np.float32)


def sample(rows: DataFrame, item: str, vector: str, dims: int, most: int, total: int) -> DataFrame:
    """``u, vec``: valid vectors of about ``most`` rows chosen by a hash of the item, with a hashed number for later draws."""
    share = min(1.0, most / max(total, 1))
    picked = rows.where(F.pmod(F.xxhash64(col(item)), F.lit(1_000_000)) < int(np.ceil(share * 1_000_000)))
    picked = picked.select(F.xxhash64(col(item), F.lit(1)).alias("u"), col(vector).cast("array<float>").alias("v")).distinct()

    def keep(batches):
        for b in batches:
            x, ok = matrix(b.column(1), dims)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), to_bytes(x[ok])], ["u", "vec"])

    return materialize(picked.repartition(PARTS, "u").mapInArrow(keep, "u long, vec binary"), "fit")


def whole(rows: DataFrame, item: str, vector: str, dims: int) -> DataFrame:
    """``id, u, vec`` as :func:`sample` gives them, of all rows with a valid vector, in as many partitions as they have."""
    picked = rows.select(col(item).alias("id"), F.xxhash64(col(item), F.lit(1)).alias("u"), col(vector).cast("array<float>").alias("v"))

    def keep(batches):
        for b in batches:
            x, ok = matrix(b.column(2), dims)
            at = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(at), b.column(1).filter(at), to_bytes(x[ok])], ["id", "u", "vec"])

    return materialize(picked.mapInArrow(keep, f"id {dict(picked.dtypes)['id']}, u long, vec binary"), "fit")


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and cosine of the nearest centroid of each row, in slices that keep the table of cosines small."""
    at, cos = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.float32)
    step = max(1, (1 << 24) // max(len(centers), 1))
    for s in range(0, len(x), step):
        sims = x[s : s + step] @ centers.T
        at[s : s + step] = sims.argmax(1)
        cos[s : s + step] = sims.max(1)
    return at, cos


def fit(points: DataFrame, k: int, rounds: int = 4, oversample: float = 0.5, passes: int = 3, seed: int = 3, many: bool = False) -> np.ndarray:
    """At most ``k`` unit centroids of the rows of :func:`sample`, or, with ``many`` for the number of partitions, of :func:`whole`; an empty table gives none."""
    sc = points.sparkSession.sparkContext
    first = points.orderBy("u").limit(1).collect()
    if not first:
        return np.zeros((0, 0), dtype=np.float32)
    centers = from_bytes([first[0]["vec"]])

    def cost_and_draw(at, chance, salt):
        sent = sc.broadcast(at)

        def run(batches):
            total, drawn = 0.0, []
            for b in batches:
                x = from_bytes(b.column("vec"))
                if not len(x):
                    continue
                d = np.maximum(2 - 2 * nearest(x, sent.value)[1], 0)
                total += float(d.sum())
                if chance:
                    u = ((b.column("u").to_numpy().astype(np.uint64) * np.uint64(2654435761 + 2 * salt)) >> np.uint64(11)).astype(np.float64) / 2**53
                    drawn.append(to_bytes(x[u < chance * d]))
            yield pa.RecordBatch.from_arrays([pa.array([total])], ["c"]) if not chance else pa.RecordBatch.from_arrays([pa.concat_arrays(drawn) if drawn else pa.array([], pa.binary())], ["v"])

        return run

    for r in range(rounds):
        total = sum(x["c"] for x in points.mapInArrow(cost_and_draw(centers, 0, 0), "c double").collect())
        if total <= 1e-6:
            break
        new = points.mapInArrow(cost_and_draw(centers, oversample * k / total, seed + r), "v binary").collect()  # about oversample * k rows
        if new:
            centers = np.concatenate([centers, from_bytes([x["v"] for x in new])])
    mass, _ = _sums(points, centers, many)
    centers = _reduce(centers, mass, k, seed)
    for _ in range(passes):
        n, s = _sums(points, centers, many)
        centers = np.where(n[:, None] > 0, _unit(s), centers).astype(np.float32)
    return centers


def _sums(points: DataFrame, centers: np.ndarray, many: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Number and vector sum of the rows nearest to each centroid. The sums of ``many`` partitions are added up before they are collected."""
    sent = points.sparkSession.sparkContext.broadcast(centers)

    def run(batches):
        c = sent.value
        n, s = np.zeros(len(c)), np.zeros(c.shape)
        for b in batches:
            x = from_bytes(b.column("vec"))
            if len(x):
                a, _ = nearest(x, c)
                n += np.bincount(a, minlength=len(c))
                np.add.at(s, a, x)
        if many:
            at = np.flatnonzero(n)
            for i in range(0, len(at), 4096):
                some = at[i : i + 4096]
                ends = pa.array(np.arange(len(some) + 1) * c.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.ListArray.from_arrays(ends, pa.array(s[some].ravel()))], ["c", "n", "s"])
            return
        yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()], pa.binary()), pa.array([s.astype(np.float32).tobytes()], pa.binary())], ["n", "s"])

    if many:
        parts = points.mapInArrow(run, "c int, n double, s array<double>").groupBy("c")
        n, s = np.zeros(len(centers)), np.zeros(centers.shape)
        for r in parts.agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s")).collect():  # a row a centroid
            n[r["c"]], s[r["c"]] = r["n"], r["s"]
        return n, s
    got = points.mapInArrow(run, "n binary, s binary").collect()  # one row a partition of the bounded sample
    n = sum(np.frombuffer(r["n"]) for r in got)
    s = sum(np.frombuffer(r["s"], dtype=np.float32).reshape(centers.shape).astype(np.float64) for r in got)
    return n, s


def _reduce(x: np.ndarray, mass: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Weighted k-means++ on the candidates."""
    if len(x) <= k:
        return x
    rng = np.random.default_rng(seed)
    picked = [int(np.argmax(mass))]
    d = np.maximum(2 - 2 * x @ x[picked[0]], 0)
    while len(picked) < k:
        p = d * (mass + 1e-9)
        if p.sum() <= 0:
            break
        picked.append(int(rng.choice(len(x), p=p / p.sum())))
        d = np.minimum(d, np.maximum(2 - 2 * x @ x[picked[-1]], 0))
    return x[picked]
