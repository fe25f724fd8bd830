"""Clusters of mutually similar records, their size and most typical members.

A vector belongs to the cell of its nearest k-means centroid, found in two levels. Inside a cell rows are gathered round leaders to nodes:
every member is alike its leader. Nodes carry their mean, the smallest and largest angle of a member to it, and whether all their members
are alike (checked pair by pair only where the angles leave it open). Nodes, a small share of the rows, then meet in the cells nearest to
their means, so rows parted by a cell's border come together again. From the angles follows for most pairs of nodes whether some or all of
their members are alike; only for the others the members themselves are compared, and of these only the ones whose angles leave it open.

Cells above ``block_rows`` rows are cut into blocks by a hash before anything is gathered. Such a cell has dense looks, whose middles are
taken from the fitted sample and shared by its blocks: rows within half the limiting angle of a middle are all alike one another, so what
the blocks gather round it is one node by adding up, and a look shared by a third of all rows is never enumerated pair by pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.llm import kmeans as km
from gleanframe.operators.graph import components
from gleanframe.session import col, materialize

SLACK = 1e-6  # float32 rounding of an angle


def _angle(c: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(c, -1.0, 1.0))


def _unit64(raw: np.ndarray) -> np.ndarray:
    """Rows at length one in double precision, where the squares of all floats have room."""
    x = raw.astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]


def gather(x: np.ndarray, cosine: float) -> np.ndarray:
    """Leader number of each unit row, in row order: the nearest leader at ``cosine`` or more, else the row leads itself."""
    lead = np.full(len(x), -1)
    heads: list[int] = []
    table = np.zeros((0, x.shape[1]), dtype=np.float32)
    for s in range(0, len(x), 512):
        part = np.arange(s, min(s + 512, len(x)))
        if len(heads):
            sims = x[part] @ table.T
            best = sims.argmax(1)
            hit = sims[np.arange(len(part)), best] >= cosine
            lead[part[hit]] = best[hit]
            part = part[~hit]
        own = x[part] @ x[part].T >= cosine
        free = np.ones(len(part), dtype=bool)
        for i in range(len(part)):
            if free[i]:
                m = own[i] & free
                m[i] = True
                lead[part[m]] = len(heads)
                heads.append(int(part[i]))
                free &= ~m
        table = x[heads]
    return lead


def _cut(x: np.ndarray) -> np.ndarray:
    """Floats cut to their upper halves."""
    return (np.ascontiguousarray(x, dtype="<f4").view("<u4") & np.uint32(0xFFFF0000)).view("<f4")


def _added(t: pa.Table) -> pa.Table:
    """The node of one shared middle from what the blocks gathered round it."""
    sums = np.frombuffer(b"".join(t.column("sum").to_pylist())).reshape(t.num_rows, -1).sum(0)
    least = pc.min(t.column("node")).as_py()
    return pa.table({
        "lead": t.column("lead").slice(0, 1), "node": pa.array([least], t.schema.field("node").type), "mean": t.column("mean").slice(0, 1), "low": [pc.min(t.column("low")).as_py()],
        "high": [pc.max(t.column("high")).as_py()], "n": [pc.sum(t.column("n")).as_py()], "tight": [True], "sum": pa.array([sums.tobytes()], pa.binary()),
    })


def _node(x: np.ndarray, raw: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """A centre, angles of the members to it, and whether all members are alike.

    The centre is the mean with its floats cut to their upper halves, which halves what is sent; the angles are to the cut centre. A member
    alone is its own centre.
    """
    if len(x) == 1:
        return raw[0], np.zeros(1), True
    mean = x.astype(np.float64).sum(0)
    mean = _cut((mean / max(np.linalg.norm(mean), 1e-12)).astype("<f4"))
    a = _angle(x.astype(np.float64) @ km.unit(mean[None])[0])
    if 2 * a.max() <= np.arccos(cosine) - SLACK:
        return mean, a, True
    # a pair that is not alike has two members further out than the limit less the largest angle
    far = x[a >= np.arccos(cosine) - a.max() - SLACK]
    for s in range(0, len(far), 1024):
        if (far[s : s + 1024] @ far.T < cosine).any():
            return mean, a, False
    return mean, a, True


class Cells:
    """Two levels of centroids: the nearest of the first, then the nearest of its own; ``probe`` gives the cells nearest to a vector."""

    def __init__(self, top: np.ndarray, below: list[np.ndarray]) -> None:
        self.top, self.below = top, below
        self.start = np.concatenate([[0], np.cumsum([len(b) for b in below])]).astype(np.int64)

    def __len__(self) -> int:
        return int(self.start[-1])

    def place(self, x: np.ndarray) -> np.ndarray:
        first = (x @ self.top.T).argmax(1) if len(x) else np.zeros(0, dtype=np.int64)
        out = np.empty(len(x), dtype=np.int64)
        for t in np.unique(first):
            at = first == t
            out[at] = self.start[t] + (x[at] @ self.below[t].T).argmax(1)
        return out

    def probe(self, x: np.ndarray, m: int) -> np.ndarray:
        """``m`` cells of each row (the last repeated where there are fewer), the nearest found below its nearest first-level centroids."""
        tops = min(len(self.top), max(3, m))
        first = np.argpartition(-(x @ self.top.T), tops - 1, axis=1)[:, :tops]
        sims = np.full((len(x), m), -np.inf, dtype=np.float32)
        cell = np.zeros((len(x), m), dtype=np.int64)
        for t in np.unique(first):
            at = np.flatnonzero((first == t).any(1))
            s = x[at] @ self.below[t].T
            k = min(m, s.shape[1])
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            both = np.concatenate([sims[at], np.take_along_axis(s, best, 1)], 1)
            names = np.concatenate([cell[at], self.start[t] + best], 1)
            keep = np.argpartition(-both, m - 1, axis=1)[:, :m]
            sims[at], cell[at] = np.take_along_axis(both, keep, 1), np.take_along_axis(names, keep, 1)
        top = np.take_along_axis(cell, sims.argmax(1)[:, None], 1)
        return np.where(np.isneginf(sims), top, cell)


MOST_SAMPLE = 200_000  # sample rows of a first-level cell its own centroids are fitted on


def fit_cells(points: DataFrame, k: int) -> Cells | None:
    """About ``k`` cells fitted on the rows of :func:`kmeans.sample`: the square root of them first, then the rest below each in a task of its own."""
    top = km.fit(points, max(1, round(np.sqrt(k))))
    if not len(top):
        return None
    total = points.count()
    sent = points.sparkSession.sparkContext.broadcast(top)

    def first(batches):
        for b in batches:
            x = km.from_bytes(b.column("vec"))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array((x @ sent.value.T).argmax(1), pa.int32()), b.column("u"), b.column("vec")], ["top", "u", "vec"])

    def below(t: pa.Table) -> pa.Table:
        t = t.sort_by("u")
        n = t.num_rows
        x = km.from_bytes(t.column("vec").slice(0, MOST_SAMPLE).combine_chunks())
        want = max(1, round(k * n / max(total, 1)))
        c = km._reduce(x, np.ones(len(x)), want, 5) if want < len(x) else x
        for _ in range(3 if want < len(x) else 0):
            a = np.concatenate([(x[s : s + 8192] @ c.T).argmax(1) for s in range(0, len(x), 8192)])
            s = np.zeros(c.shape)
            np.add.at(s, a, x)
            c = np.where(np.bincount(a, minlength=len(c))[:, None] > 0, km._unit(s), c).astype(np.float32)
        return pa.table({"top": pa.array([t.column("top")[0].as_py()] * len(c), pa.int32()), "c": km.to_bytes(c)})

    rows = points.mapInArrow(first, "top int, u long, vec binary").groupBy("top").applyInArrow(below, "top int, c binary").collect()  # centroids: a row of many thousand
    kept: dict[int, list[bytes]] = {}
    for r in rows:
        kept.setdefault(r["top"], []).append(r["c"])
    return Cells(top, [km.from_bytes(kept[t]) if t in kept else top[t : t + 1] for t in range(len(top))])


def shared_middles(points: DataFrame, cells: Cells, total: int, cosine: float, block_rows: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Into how many blocks each cell is cut, and the middles of dense looks of the cells cut into several, from the fitted sample."""
    sent = points.sparkSession.sparkContext.broadcast(cells)
    dims = cells.top.shape[1]

    def place(batches):
        for b in batches:
            x = km.from_bytes(b.column("vec"))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(sent.value.place(x), pa.int32()), b.column("u"), b.column("vec")], ["cell", "u", "vec"])

    placed = materialize(points.mapInArrow(place, "cell int, u long, vec binary"), "fit_cells")
    n = np.zeros(len(cells))
    for r in placed.groupBy("cell").count().collect():  # a row a cell
        n[r["cell"]] = r["count"]
    salts = np.maximum(1, np.ceil(n / max(n.sum(), 1) * total / block_rows)).astype(np.int64)
    hot = np.flatnonzero(salts > 1)

    def looks(t: pa.Table) -> pa.Table:
        t = t.sort_by("u")
        x = km.from_bytes(t.column("vec").slice(0, MOST_SAMPLE).combine_chunks())
        lead = gather(x, cosine)
        size = np.bincount(lead)
        s = np.zeros((len(size), x.shape[1]))
        np.add.at(s, lead, x)
        # a look of a block's worth of rows or more shows in the sample many times
        m = km._unit(s[size >= 8])
        return pa.table({"cell": pa.array([t.column("cell")[0].as_py()] * len(m), pa.int32()), "m": km.to_bytes(m) if len(m) else pa.array([], pa.binary())})

    out: dict[int, list[bytes]] = {}
    if len(hot):
        some = placed.where(F.col("cell").isin([int(c) for c in hot])) if len(hot) <= 1000 else placed
        for r in some.groupBy("cell").applyInArrow(looks, "cell int, m binary").collect():  # an eighth of a bounded sample at most
            if salts[r["cell"]] > 1:
                out.setdefault(r["cell"], []).append(r["m"])
    return salts, {c: km.from_bytes(m).reshape(-1, dims) for c, m in out.items()}


def alike_clusters(
    rows: DataFrame, item: str, vector: str, dims: int = 64, cosine: float = 0.9, cell_rows: int = 4000, most_cells: int = 262_144, fit_rows: int = 100_000, block_rows: int = 8192, probes: int = 4,
    meet_nodes: int = 8192,
) -> DataFrame:
    """``<item>, cluster_id, size, angle, alike`` for every valid row.

    Rows linked by a cosine of at least ``cosine``, directly or over others, share a cluster, named by its smallest item; ``size`` is its
    number of items, ``alike`` whether all its members are alike each other, ``angle`` the member's angle to the mean direction of all
    members of the cluster, in whatever nodes they are, to nine decimals: the most typical members have the smallest. Cells are fitted on at
    most about ``fit_rows`` rows, or twenty a cell; every row is placed. There are as many cells as rows need at ``cell_rows`` each, up to
    ``most_cells``, which bounds the centroids sent out to 64 MB; beyond, cells grow, and are cut into blocks for gathering and into stripes
    of ``meet_nodes`` where nodes meet. ``probes`` is the number of cells a node's mean is compared in; the recall this gives is measured in
    the tests.

    Defined cases: a NULL item, and a vector that is NULL, not of ``dims`` values, not finite or all zero, do not count; vectors need not
    be of unit length; an item given again with the same vector counts once; equal vectors are alike; an empty table gives no rows;
    further columns are ignored, whatever their names.
    """
    sc = rows.sparkSession.sparkContext
    base = rows.select(col(item).alias("id"), col(vector).cast("array<float>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dims))
    kind = dict(base.dtypes)["id"]
    total = base.count()
    k = int(np.clip(round(total / cell_rows), 1, most_cells))
    points = km.sample(base, "id", "v", dims, max(fit_rows, 20 * k), total)
    cells = fit_cells(points, k)
    if cells is None:
        return base.where(F.lit(False)).select(F.col("id").alias(item), F.col("id").alias("cluster_id"), F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("angle"), F.lit(True).alias("alike"))
    salts, middles = shared_middles(points, cells, total, cosine, block_rows)
    # numbers of all shared middles, and each with its floats cut as node centres are
    first_lead, centres = {}, {}
    for c in sorted(middles):
        first_lead[c] = sum(len(centres[x]) for x in centres)
        centres[c] = _cut(middles[c])
    sent = sc.broadcast((cells, salts))
    shared = sc.broadcast((first_lead, centres))
    half = float(np.arccos(cosine)) / 2 - SLACK

    def place(batches):
        cells, s = sent.value
        for b in batches:
            raw, ok = km.raw_matrix(b.column(1), dims)
            raw = raw[ok]
            cell = cells.place(km.unit(raw))
            block = np.abs(b.column(2).filter(pa.array(ok)).to_numpy()) % s[cell]
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(block, pa.int32()), b.column(0).filter(pa.array(ok)), km.to_bytes(raw)], ["cell", "block", "id", "vec"])

    placed = base.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(2**31)).alias("h")).mapInArrow(place, f"cell int, block int, id {kind}, vec binary")

    def nodes_of(t: pa.Table) -> pa.Table:
        cell = t.column("cell")[0].as_py()
        p = t.sort_by("id").combine_chunks()
        ids = p.column("id").to_pandas()
        first = ~ids.duplicated().to_numpy()
        p = p.filter(pa.array(first))
        ids = ids[first].to_numpy()
        raw = km.from_bytes(p.column("vec"))  # as delivered: unit vectors would compress worse
        x = km.unit(raw)
        node, angle, lead_of = np.empty(len(ids), dtype=ids.dtype), np.empty(len(ids)), np.full(len(ids), -1)
        out: dict[str, list] = {"node": [], "mean": [], "low": [], "high": [], "n": [], "tight": [], "sum": [], "lead": []}

        def put(m, mean, a, tight, lead):
            name = ids[m].min()
            node[m], angle[m], lead_of[m] = name, a, lead
            for key, value in zip(out, (name, mean, a.min(), a.max(), len(m), tight, None if len(m) == 1 and lead < 0 else _unit64(raw[m]).sum(0).tobytes(), lead)):
                out[key].append(value)

        starts, tables = shared.value
        rest = np.arange(len(ids))
        if cell in tables:
            c = km.unit(tables[cell])
            near = np.concatenate([(x[s : s + 4096] @ c.T).argmax(1) for s in range(0, len(x), 4096)])
            off = _angle((x.astype(np.float64) * c[near]).sum(1))
            for j in np.unique(near[off <= half]):
                m = np.flatnonzero((near == j) & (off <= half))
                put(m, tables[cell][j], off[m], True, starts[cell] + int(j))
            rest = np.flatnonzero(off > half)
        lead = gather(x[rest], cosine)
        order = np.argsort(lead, kind="stable")
        for m in np.split(rest[order], np.flatnonzero(np.diff(lead[order])) + 1) if len(rest) else []:
            mean, a, tight = _node(x[m], raw[m], cosine)
            put(m, mean, a, tight, -1)
        kn = len(out["node"])
        idt = p.schema.field("id").type
        return pa.table({
            "id": pa.concat_arrays([pa.array(ids, idt), pa.nulls(kn, idt)]), "node": pa.array(np.concatenate([node, np.array(out["node"])]), idt),
            "vec": pa.concat_arrays([p.column("vec").combine_chunks() if isinstance(p.column("vec"), pa.ChunkedArray) else p.column("vec"), km.to_bytes(np.array(out["mean"]))]),
            "low": np.concatenate([angle, out["low"]]), "high": np.concatenate([angle, out["high"]]), "n": pa.array([0] * len(ids) + out["n"], pa.int64()),
            "tight": pa.array([True] * len(ids) + out["tight"], pa.bool_()), "sum": pa.array([None] * len(ids) + out["sum"], pa.binary()),
            "lead": pa.array(np.concatenate([lead_of, np.array(out["lead"], dtype=np.int64)]), pa.int64()),
        })

    schema = f"id {kind}, node {kind}, vec binary, low double, high double, n long, tight boolean, sum binary, lead long"
    # rows (id set) and their nodes (id NULL) in one table, read by columns afterwards
    both = materialize(placed.groupBy("cell", "block").applyInArrow(nodes_of, schema), "nodes")
    members = both.where("id IS NOT NULL").select("id", "node", "vec", "lead")
    own = both.where("id IS NULL").select("node", F.col("vec").alias("mean"), "low", "high", "n", "tight", "sum", "lead")
    nodes = own.where("lead < 0").drop("lead")
    if middles:
        joint = materialize(own.where("lead >= 0").groupBy("lead").applyInArrow(_added, f"lead long, node {kind}, mean binary, low double, high double, n long, tight boolean, sum binary"), "joint")
        nodes = nodes.unionByName(joint.drop("lead"))
        # a row a shared middle, of which a bounded sample gives few
        names = joint.select(F.col("lead").alias("l2"), F.col("node").alias("whole"))
        members = members.join(F.broadcast(names), F.col("lead") == F.col("l2"), "left").withColumn("node", F.coalesce("whole", "node"))
    members = members.select("id", "node", "vec")
    pairs = materialize(_meet(nodes, cells, cosine, probes, kind, meet_nodes), "pairs")
    open_pairs = pairs.where("NOT every")
    solved = _compare(members, nodes, open_pairs, cosine, kind)
    known = materialize(pairs.where("every").select("a", "b", F.lit(True).alias("link"), F.lit(True).alias("every")).unionByName(solved), "known")
    part = components(known.where("link"))
    named = nodes.join(part.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left").select("node", "mean", "high", "n", "tight", "sum", F.coalesce("component", "node").alias("cluster"))
    named = materialize(named, "named")
    verdict = _verdicts(named, known, members, cosine, kind)
    where = named.select("node", "cluster").join(verdict, "cluster").join(_middles(named, dims), "cluster", "left")
    where = materialize(where, "verdicts")

    def to_middle(vec: pa.Array, middle: pa.Array) -> pa.Array:
        out = np.zeros(len(vec))  # a member alone in its cluster is its middle
        has = middle.is_valid()
        at = has.to_numpy(zero_copy_only=False)
        if at.any():
            x, c = _unit64(km.from_bytes(vec.filter(has))), middle.filter(has).flatten().to_numpy().reshape(-1, dims)
            # by the chord, exact for small angles too: the two members of a pair must not differ by rounding
            out[at] = np.round(2 * np.arcsin(np.minimum(np.linalg.norm(x - c, axis=1) / 2, 1.0)), 9)
        return pa.array(out)

    angle = F.arrow_udf(to_middle, "double")("vec", "middle")
    return members.select("id", "node", "vec").join(where, "node").select(F.col("id").alias(item), F.col("cluster").alias("cluster_id"), "size", angle.alias("angle"), "alike")


def _middles(named: DataFrame, dims: int) -> DataFrame:
    """``cluster, middle``: the mean direction of the members of each cluster of two or more, from the vector sums of its nodes."""

    def sums(batches):
        for b in batches:
            s, lone = b.column("sum"), b.column("sum").is_null()
            at = lone.to_numpy(zero_copy_only=False)
            x = np.empty((len(s), dims))
            if at.any():
                x[at] = _unit64(km.from_bytes(b.column("mean").filter(lone)))
            if not at.all():
                x[~at] = np.frombuffer(b"".join(s.filter(s.is_valid()).to_pylist())).reshape(-1, dims)
            yield pa.RecordBatch.from_arrays([b.column("cluster"), pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * dims, pa.int32()), pa.array(x.ravel()))], ["cluster", "s"])

    many = named.groupBy("cluster").agg(F.sum("n").alias("size")).where("size >= 2").select("cluster")
    kind = dict(named.dtypes)["cluster"]
    rows = named.join(many, "cluster", "left_semi").select("cluster", "mean", "sum").mapInArrow(sums, f"cluster {kind}, s array<double>")
    total = rows.groupBy("cluster").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))

    def scaled(s: pa.Array) -> pa.Array:
        x = _unit64(s.flatten().to_numpy().reshape(-1, dims))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * dims, pa.int32()), pa.array(x.ravel()))

    return total.select("cluster", F.arrow_udf(scaled, "array<double>")("s").alias("middle"))


def _meet(nodes: DataFrame, cells: Cells, cosine: float, probes: int, kind: str, meet_nodes: int) -> DataFrame:
    """Pairs of nodes that may hold alike members: ``a, b, some, every``, as far as the angles tell.

    The nodes of a cell above ``meet_nodes`` are cut into stripes, of which every two meet in a task; only pairs near enough go on."""
    sent = nodes.sparkSession.sparkContext.broadcast(cells)
    m = min(probes, len(cells))

    def spread(batches):
        for b in batches:
            x = km.unit(km.from_bytes(b.column("mean")))
            if not len(x):
                continue
            top = sent.value.probe(x, m)
            row = np.repeat(np.arange(len(x)), m)
            once = np.unique(np.stack([row, top.ravel()], 1), axis=0)
            at = pa.array(once[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(once[:, 1], pa.int32()), *[b.column(c).take(at) for c in ("node", "mean", "low", "high")]], ["cell", "node", "mean", "low", "high"])

    limit = float(np.arccos(cosine))

    def pair(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        names = t.column("node").to_numpy()
        x = km.unit(km.from_bytes(t.column("mean").combine_chunks()))
        low, high, side = t.column("low").to_numpy(), t.column("high").to_numpy(), t.column("side").to_numpy()
        across = t.column("one")[0].as_py() != t.column("two")[0].as_py()
        got: list[tuple] = []
        for s in range(0, len(x), 1024):
            sims = x[s : s + 1024] @ x.T
            i, j = np.nonzero(sims >= np.cos(np.minimum(limit + 2 * high.max() + SLACK, np.pi)))
            keep = (i + s < j) & ((side[i + s] != side[j]) | (not across))
            i, j = i[keep], j[keep]
            d = _angle(sims[i, j].astype(np.float64))
            i = i + s
            may = d <= limit + high[i] + high[j] + SLACK
            i, j, d = i[may], j[may], d[may]
            got.append((names[i], names[j], d + low[i] + low[j] <= limit - SLACK, d + high[i] + high[j] <= limit - SLACK))
        a, b, some, every = (np.concatenate(c) for c in zip(*got))
        idt = t.schema.field("node").type
        return pa.table({"a": pa.array(a, idt), "b": pa.array(b, idt), "some": pa.array(some, pa.bool_()), "every": pa.array(every, pa.bool_())})

    out = nodes.select("node", "mean", "low", "high").mapInArrow(spread, f"cell int, node {kind}, mean binary, low double, high double")
    # cells of one stripe need no entry: there is at most one other for every ``meet_nodes`` nodes
    stripes = materialize(out.groupBy(F.col("cell").alias("c2")).agg(F.ceil(F.count("*") / meet_nodes).cast("int").alias("stripes")).where("stripes > 1"), "stripes")
    out = out.join(F.broadcast(stripes), F.col("cell") == F.col("c2"), "left").withColumn("stripes", F.coalesce("stripes", F.lit(1)))
    out = out.withColumn("side", F.pmod(F.xxhash64("node"), "stripes").cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)))
    out = out.select("cell", F.least("side", "to").alias("one"), F.greatest("side", "to").alias("two"), "side", "node", "mean", "low", "high")
    return out.groupBy("cell", "one", "two").applyInArrow(pair, f"a {kind}, b {kind}, some boolean, every boolean").distinct()


def _compare(members: DataFrame, nodes: DataFrame, pairs: DataFrame, cosine: float, kind: str) -> DataFrame:
    """``a, b, link, every`` of pairs of nodes by their members: of each side only the rows whose angle to the other mean leaves it open."""
    limit = float(np.arccos(cosine))
    about = lambda end: nodes.select(F.col("node").alias(end), F.col("mean").alias(f"mean_{end}"), F.col("high").alias(f"high_{end}"))
    full = pairs.join(about("a"), "a").join(about("b"), "b")
    sides = full.select("a", "b", "some", F.lit(0).alias("side"), F.col("a").alias("node"), F.col("mean_b").alias("other"), F.col("high_b").alias("reach"))
    sides = sides.unionByName(full.select("a", "b", "some", F.lit(1).alias("side"), F.col("b").alias("node"), F.col("mean_a").alias("other"), F.col("high_a").alias("reach")))
    rows = members.select("node", "vec").join(sides, "node")

    def near(batches):
        for b in batches:
            x, o = km.unit(km.from_bytes(b.column("vec"))), km.unit(km.from_bytes(b.column("other")))
            if not len(x):
                continue
            d = _angle((x.astype(np.float64) * o).sum(1))
            reach, some = b.column("reach").to_numpy(), b.column("some").to_numpy(zero_copy_only=False)
            far = d + reach > limit - SLACK
            keep = pa.array(far | (~some & (d - reach <= limit + SLACK)))
            yield pa.RecordBatch.from_arrays([b.column(c).filter(keep) for c in ("a", "b", "some", "side", "vec")], ["a", "b", "some", "side", "vec"])

    kept = rows.select("a", "b", "some", "side", "vec", "other", "reach").mapInArrow(near, f"a {kind}, b {kind}, some boolean, side int, vec binary")

    def decide(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        x = km.unit(km.from_bytes(t.column("vec").combine_chunks()))
        p, q = x[side == 0], x[side == 1]
        link, every = bool(t.column("some")[0].as_py()), True
        for s in range(0, len(p), 1024):
            if len(q):
                m = p[s : s + 1024] @ q.T >= cosine
                link, every = link or bool(m.any()), every and bool(m.all())
        return pa.table({"a": t.column("a").slice(0, 1), "b": t.column("b").slice(0, 1), "link": [link], "every": [every]})

    told = kept.groupBy("a", "b").applyInArrow(decide, f"a {kind}, b {kind}, link boolean, every boolean")
    told = materialize(told, "told")
    # a pair none of whose rows is left: all are alike where some are, else none is
    silent = pairs.join(told.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", F.col("some").alias("link"), F.col("some").alias("every"))
    return told.unionByName(silent)


def _verdicts(named: DataFrame, known: DataFrame, members: DataFrame, cosine: float, kind: str) -> DataFrame:
    """``cluster, size, alike``: all nodes tight and all their pairs alike; pairs that never met are compared now."""
    sums = named.groupBy("cluster").agg(F.sum("n").alias("size"), F.count("*").alias("k"), F.min("tight").alias("tight"))
    inside = known.join(named.select(F.col("node").alias("a"), F.col("cluster").alias("ca")), "a").join(named.select(F.col("node").alias("b"), F.col("cluster").alias("cb")), "b").where("ca = cb")
    met = inside.groupBy(F.col("ca").alias("cluster")).agg(F.count("*").alias("met"), F.min("every").alias("every"))
    told = materialize(sums.join(met, "cluster", "left").withColumn("good", F.col("tight") & F.coalesce("every", F.lit(True))), "told")
    short = told.where(F.col("good") & (F.coalesce("met", F.lit(0)) < F.col("k") * (F.col("k") - 1) / 2)).select("cluster")
    limit = float(np.arccos(cosine))

    def open_pairs(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        names, high = t.column("node").to_numpy(), t.column("high").to_numpy()
        x = km.unit(km.from_bytes(t.column("mean").combine_chunks())).astype(np.float64)
        middle = x.sum(0) / max(np.linalg.norm(x.sum(0)), 1e-12)
        got: list[tuple] = []
        # where all members lie within half the limit of one middle, all are alike
        if 2 * (_angle(x @ middle) + high).max() > limit - SLACK:
            for s in range(0, len(x), 1024):
                d = _angle(x[s : s + 1024] @ x.T)
                reach = high[s : s + 1024, None] + high[None, :]
                if (d > limit + reach + SLACK).any():  # two nodes without any alike members
                    got = [(names[:1], names[:1])]
                    break
                i, j = np.nonzero(d + reach > limit - SLACK)
                got.append((names[i[i + s < j] + s], names[j[i + s < j]]))
        a, b = (np.concatenate(c) for c in zip(*got)) if got else (names[:0], names[:0])
        idt = t.schema.field("node").type
        return pa.table({"cluster": pa.array([t.column("cluster")[0].as_py()] * len(a), t.schema.field("cluster").type), "a": pa.array(a, idt), "b": pa.array(b, idt)})

    some = named.join(short, "cluster", "left_semi").select("cluster", "node", "mean", "high")
    met = materialize(some.groupBy("cluster").applyInArrow(open_pairs, f"cluster {kind}, a {kind}, b {kind}"), "met")
    apart = met.where("a = b").select("cluster").distinct().withColumn("apart", F.lit(True))
    told = told.join(apart, "cluster", "left").withColumn("good", F.col("good") & F.col("apart").isNull()).drop("apart")
    unmet = met.where("a <> b").join(known.select("a", "b"), ["a", "b"], "left_anti")
    unmet = materialize(unmet, "unmet")
    if unmet.isEmpty():
        return told.select("cluster", "size", F.col("good").alias("alike"))
    solved = _compare(members, named.select("node", "mean", "high"), unmet.select("a", "b", F.lit(True).alias("some")), cosine, kind)
    bad = solved.where("NOT every").join(unmet, ["a", "b"]).select("cluster").distinct().withColumn("bad", F.lit(True))
    return told.join(bad, "cluster", "left").select("cluster", "size", (F.col("good") & F.col("bad").isNull()).alias("alike"))


def typical(found: DataFrame, item: str, n: int = 3) -> DataFrame:
    """``cluster_id, size, place, <item>``: of each cluster of two or more its ``n`` members nearest to the middle."""
    w = Window.partitionBy("cluster_id").orderBy("angle", col(item))
    ranked = found.where("size >= 2").withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    return ranked.select("cluster_id", "size", "place", col(item))


def kmeans_groups(rows: DataFrame, item: str, vector: str, weights: dict[str, float], k: int, dims: int = 64, hashed_dims: int = 64, n: int = 3) -> DataFrame:
    """``cluster, size, place, <item>, angle``: k-means clusters of vectors with hashed weighted features, each with its ``n`` members nearest to the centroid.

    A row's vector at length one is followed by ``hashed_dims`` places to which every column of ``weights`` adds its weight, signed, where
    the hash of its value says; so rows of one scene stand nearer than rows of equal look from two. At most ``k`` centroids are seeded and
    fitted on all rows, and every row is placed. Equal angles go by the smaller item.

    Defined cases: a NULL item, and vectors that are NULL, not of ``dims`` values, not finite or all zero do not count; a NULL feature adds
    nothing; an item given again counts once (its smallest vector and features); an empty table gives no rows.
    """
    sc = rows.sparkSession.sparkContext
    names = list(weights)
    f = [f"f{i}" for i in range(len(names))]
    base = rows.select(col(item).alias("id"), col(vector).cast("array<float>").alias("v"), *[col(c).cast("string").alias(a) for c, a in zip(names, f)]).where(F.col("id").isNotNull() & (F.size("v") == dims))
    kind = dict(base.dtypes)["id"]
    width = dims + hashed_dims

    def features(batches):
        for b in batches:
            x, ok = km.matrix(b.column(1), dims)
            h = km.hashed({c: b.column(2 + i) for i, c in enumerate(names)}, weights, hashed_dims) if names else np.zeros((len(x), hashed_dims), np.float32)
            both = np.concatenate([x, h], 1)[ok]
            at = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(at), pa.ListArray.from_arrays(pa.array(np.arange(len(both) + 1) * width, pa.int32()), pa.array(both.ravel()))], ["id", "v"])

    made = base.mapInArrow(features, f"id {kind}, v array<float>")
    points = km.whole(made.groupBy("id").agg(F.min("v").alias("v")), "id", "v", width)
    centers = km.fit(points, k, many=True)
    if not len(centers):
        return base.where(F.lit(False)).select(F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("place"), F.col("id").alias(item), F.lit(0.0).alias("angle"))
    sent = sc.broadcast(centers)

    def place(batches):
        for b in batches:
            x = km.from_bytes(b.column("vec"))
            if len(x):
                at, cos = km.nearest(x, sent.value)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(at, pa.int32()), pa.array(np.round(_angle(cos.astype(np.float64)), 6))], ["id", "cluster", "angle"])

    placed = materialize(points.mapInArrow(place, f"id {kind}, cluster int, angle double"), "placed")
    w = Window.partitionBy("cluster").orderBy("angle", "id")
    near = placed.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    return near.join(placed.groupBy("cluster").agg(F.count("*").alias("size")), "cluster").select("cluster", "size", "place", F.col("id").alias(item), "angle")
