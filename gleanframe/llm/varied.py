"""A varied subset of asked-for size from every group, by mini-batch k-means strata and quotas.

Views are clusters of the feature vectors over all groups, from mini-batch k-means: each step takes a batch of rows by a hash of the item
and moves the centroids towards them with a rate that falls with their mass. Their number grows with the square root of the rows. A
group's rows fall into strata by view. Every stratum gets a quota, by the square root of its size or equally; slots a small stratum cannot
use are handed on to the others (water filling). Inside a stratum, directions of the vector (by the sides of a few planes), buckets and
moments take turns, and better scores come first.

What a stratum offers, eight rows for every slot and some more, is then walked: rows alike one already chosen from the group, or without
a vector, wait until all quotas and the slots left over have been filled with rows that are not. Vectors are compared in 8 bits a value.
The walk tells whether rows that were not offered could have changed it. Where they could, and where a size exceeds ``piece``, the group is
walked anew over all its rows, in rounds.

No group is ever collected: strata and turns are counted by aggregates, rankings keep only as many rows as a stratum offers, which Spark
prunes in every partition before the exchange. Rounds rank by range sorts, walk the ``window`` first open rows of a group in one task and
test the others against what was taken in blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.llm import kmeans as km
from gleanframe.operators.ranks import numbered
from gleanframe.session import col, forget, materialize, spread

BLOCK = 8192  # rows of a group tested in one call against what a round took


def mini_batch(points: DataFrame, k: int, steps: int = 8) -> np.ndarray:
    """At most ``k`` unit centroids of the rows of :func:`kmeans.sample`, refined by ``steps`` batches of a ``steps``-th of them each."""
    centers = km.fit(points, k, rounds=4, oversample=2.0, passes=0)
    if not len(centers):
        return centers
    mass = np.ones(len(centers))
    for s in range(steps):
        n, total = km._sums(points.where(F.pmod("u", F.lit(steps)) == s), centers)
        mean = total / np.maximum(n, 1)[:, None]
        rate = (n / (mass + n))[:, None]
        moved = (1 - rate) * centers + rate * mean
        centers = (moved / np.maximum(np.linalg.norm(moved, axis=1), 1e-12)[:, None]).astype(np.float32)
        mass += n
    return centers


def merged(centers: np.ndarray, cosine: float) -> np.ndarray:
    """View number of every centroid: centroids alike by ``cosine``, directly or over others, are one view, so that a look with very many
    rows, which k-means cuts into several clusters, does not get the quotas of several views."""
    view = np.arange(len(centers))
    links = [np.nonzero(centers[s : s + 1024] @ centers.T >= cosine) for s in range(0, len(centers), 1024)]
    i = np.concatenate([a + 1024 * n for n, (a, _) in enumerate(links)] or [np.zeros(0, int)])
    j = np.concatenate([b for _, b in links] or [np.zeros(0, int)])
    while True:
        new = view.copy()
        np.minimum.at(new, i, view[j])
        if (new == view).all():
            return view
        view = new


def quotas(strata: DataFrame, group: Sequence[str], stratum: str, size: Column, by: str = "sqrt", n: str = "n") -> DataFrame:
    """Adds ``quota`` to a table of strata with their sizes ``n``: shares by ``by`` ("sqrt" or "equal"), at most the stratum's size, adding up
    to the asked size or the whole group. Left-over slots go to the strata with the largest fractions, then the larger, then the smaller name.

    Water filling in closed form: with strata in rising order of size over weight, a stratum is taken whole while its size does not
    exceed its share of what is left; the others share the rest by weight.
    """
    weight = F.sqrt(F.col(n)) if by == "sqrt" else F.lit(1.0)
    by_fill = Window.partitionBy(*group).orderBy(F.col(n) / F.col("w"), F.col(stratum))
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(0, Window.unboundedFollowing)
    s = strata.withColumn("w", weight).withColumn("want", size.cast("double"))
    s = s.withColumn("left", F.col("want") - F.coalesce(F.sum(n).over(before), F.lit(0))).withColumn("wr", F.sum("w").over(onward))
    s = s.withColumn("whole", (F.col("left") > 0) & (F.col(n) <= F.col("left") * F.col("w") / F.col("wr")))
    # the first stratum that is not taken whole fixes the level for all after it
    everyone = Window.partitionBy(*group)
    s = s.withColumn("full", F.sum(F.when(F.col("whole"), F.col(n)).otherwise(0)).over(everyone)).withColumn("rest_w", F.sum(F.when(F.col("whole"), 0.0).otherwise(F.col("w"))).over(everyone))
    share = F.when(F.col("whole"), F.col(n).cast("double")).otherwise((F.col("want") - F.col("full")) * F.col("w") / F.col("rest_w"))
    s = s.withColumn("share", F.greatest(F.least(share, F.col(n).cast("double")), F.lit(0.0))).withColumn("quota", F.floor(F.col("share") + F.lit(1e-9)))
    spare = F.least(F.col("want"), F.sum(n).over(everyone).cast("double")) - F.sum("quota").over(everyone)
    s = s.withColumn("spare", spare)
    turn = Window.partitionBy(*group).orderBy((F.col("quota") >= F.col(n)), F.desc(F.col("share") - F.col("quota")), F.desc(n), F.col(stratum))
    s = s.withColumn("quota", F.col("quota") + F.when((F.row_number().over(turn) <= F.round("spare")) & (F.col("quota") < F.col(n)), 1).otherwise(0))
    return s.select(*strata.columns, F.col("quota").cast("long").alias("quota"))


def _vectors(small: pd.Series, dims: int) -> np.ndarray:
    x = np.frombuffer(b"".join(small), dtype=np.int8).reshape(len(small), dims).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]


def _walk(x: np.ndarray, near: np.ndarray, stratum: np.ndarray, want: dict, room: int, cosine: float) -> list[int]:
    """Rows taken in order that are not ``near``, up to ``room`` and, where ``want`` is not empty, what it leaves each stratum. Marks in
    ``near`` what is alike a taken row, and the row itself, and lowers ``want``."""
    out: list[int] = []
    for i, s in enumerate(stratum):
        if len(out) >= room:
            break
        if not near[i] and (not want or want[s] > 0):
            out.append(i)
            near |= x @ x[i] >= cosine
            near[i] = True
            if want:
                want[s] -= 1
    return out


def chosen(x: np.ndarray, known: np.ndarray, stratum: np.ndarray, turn: np.ndarray, quota: np.ndarray, n: np.ndarray, cosine: float) -> tuple[list[int], bool]:
    """Rows taken of a pool in order of place, as many as the quotas of its strata add up to: first each stratum's quota of rows alike none
    taken, then such rows of any stratum while slots are left, then the others in order. And whether all ``n`` rows of each stratum, of
    which the pool may hold the first turns only, would give the same."""
    want = {s: int(q) for s, q in zip(stratum, quota)}
    size = dict(zip(stratum, n))
    room = sum(want.values())
    cut = {s: held for s, held in zip(*np.unique(stratum, return_counts=True)) if held < size[s]}
    seen = [s for s in cut if known[stratum == s].any()]
    near = ~known  # what a row without a vector shows is not known
    out = _walk(x, near, stratum, want, room, cosine)
    proven = all(want[s] == 0 for s in seen)
    # up to this turn the pool holds all rows
    whole = min((cut[s] for s in seen), default=np.inf)
    more = _walk(x, near, stratum, {}, room - len(out), cosine)
    out += more
    proven &= bool(len(more) == 0 or turn[more].max() <= whole) and (len(out) == room or whole == np.inf)
    if len(out) < room:
        free = np.ones(len(x), dtype=bool)
        free[out] = False
        rest = np.flatnonzero(free)[: room - len(out)].tolist()
        out += rest
        whole = min(cut.values(), default=np.inf)
        proven &= bool(len(rest) == 0 or turn[rest].max() <= whole) and (len(out) == room or whole == np.inf)
    return out, bool(proven)


def _rounds(ranked: DataFrame, cosine: float, dims: int, window: int, top: int) -> DataFrame:
    """``grp, item, view, place`` as :func:`chosen` takes them of all rows ``grp, view, item, turn, none, low, small, want, room, block``.

    The ``window`` first open rows of every group are walked in one task; then rows alike one taken are dropped everywhere, in blocks, and
    the next follow. A row before the last of a window is taken, alike one taken or of a stratum that wants no more: as in the plain walk."""
    kinds = dict(ranked.dtypes)
    by = ["turn", "none", "low", "item"]
    first = Window.partitionBy("grp").orderBy(*by)
    columns = ["grp", "view", "item", *by[:3], "small", "want", "room", "block"]
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns)
    picked = f"grp {kinds['grp']}, item {kinds['item']}, view int, small binary, at long"
    picks = ranked.sparkSession.createDataFrame([], picked + ", step int")
    rest = materialize(ranked.where("view >= 0").select(*columns), "open")
    step = 0

    def walk(own):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(by, kind="stable").reset_index(drop=True)
            want = dict(zip(pdf["view"], pdf.want)) if own else {}
            at = _walk(_vectors(pdf.small, dims), np.zeros(len(pdf), dtype=bool), pdf["view"].to_numpy(), want, int(pdf.room.iloc[0]), cosine)
            return pdf.iloc[at][["grp", "item", "view", "small"]].assign(at=np.arange(len(at)))

        return run

    def sweep(pdf: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) and len(new):
            near = (_vectors(pdf.small, dims) @ _vectors(new.small, dims).T >= cosine).any(1) | pdf["item"].isin(new["item"]).to_numpy()
            pdf = pdf.assign(want=pdf.want - pdf["view"].map(new["view"].value_counts()).fillna(0).astype("int64"), room=pdf.room - len(new))[~near]
            pdf = pdf[pdf.room > 0]
        return pdf[columns]

    for own in (True, False):
        while True:
            head = rest.where("want > 0" if own else "true").withColumn("r", F.row_number().over(first)).where(F.col("r") <= window)
            new = materialize(spread(head.select(*columns), "grp").groupBy("grp").applyInPandas(walk(own), picked).withColumn("step", F.lit(step)), "round")
            if new.isEmpty():
                break
            picks, step = picks.unionByName(new), step + 1
            # one entry for every block of a group that is still open
            blocks = rest.select(F.col("grp").alias("g2"), F.col("block").alias("b2")).distinct()
            told = new.join(blocks, F.col("grp") == F.col("g2")).select("grp", "item", "view", "small", F.col("b2").alias("block"))
            left = materialize(rest.groupBy("grp", "block").cogroup(told.groupBy("grp", "block")).applyInPandas(sweep, schema), "open")
            forget(rest)
            rest = left
    picks = picks.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy("step", "at"))).select("grp", "item", "view", "place")
    picks = materialize(picks, "taken")
    # slots still free go to the first of the other rows
    got = picks.groupBy("grp").agg(F.count("*").alias("got"))
    free = ranked.select("grp", "item", "view", *by[:3], "room").join(picks.select("grp", "item"), ["grp", "item"], "left_anti")
    free = free.withColumn("r", F.row_number().over(first)).where(F.col("r") <= top).join(got, "grp", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    free = free.where("r + got <= room").select("grp", "item", "view", (F.col("r") + F.col("got")).cast("int").alias("place"))
    return picks.unionByName(free)


def varied_subset(
    rows: DataFrame, group: str, item: str, vector: str, score: str, turns: Sequence[str], size: int | DataFrame, by: str = "sqrt", views: int | None = None, dims: int = 64,
    fit_rows: int = 50_000, view_cosine: float = 0.9, piece: int = 1000, window: int = 10_000,
) -> DataFrame:
    """``<group>, <item>, view, place``: of each group ``size`` items, or all where it has fewer.

    ``size`` is a number, or a table ``<group>, size`` (a group not in it gets none). ``turns`` are columns, such as bucket and moment, whose
    values take turns inside a view. ``view`` is the k-means cluster (clusters whose centroids are alike by ``view_cosine`` are one view), -1
    for rows without a valid vector, which form a view of their own; ``place`` is the order of choice in the group. ``views`` is the number
    of centroids, by default the square root of the number of rows, 64 at least; they are fitted on about ``fit_rows`` rows, or twenty a
    centroid; every row is assigned. Up to a size of ``piece`` a group is first walked in one task over what its strata offer; ``piece`` and
    ``window``, the rows walked at once of a larger one, shape the work only.

    Defined cases: NULL groups and items do not count; an item given again counts once (with its greatest score); NULL or not-a-number
    scores rank last; a NULL turn value is a value of its own; equal scores go by the smaller item; an empty table gives no rows; further
    columns are ignored, whatever their names.
    """
    sc = rows.sparkSession.sparkContext
    t = ["side", *[f"t{i}" for i in range(len(turns))]]
    value = F.when(F.isnan(col(score).cast("double")), None).otherwise(col(score).cast("double"))
    base = rows.select(col(group).alias("grp"), col(item).alias("item"), col(vector).cast("array<float>").alias("v"), value.alias("score"), *[F.coalesce(col(c).cast("string"), F.lit("\0")).alias(a) for c, a in zip(turns, t[1:])])
    base = base.dropna(subset=["grp", "item"])
    if isinstance(size, DataFrame):
        sizes = materialize(size.select(col(group).alias("g2"), F.col("size").cast("long").alias("want")).dropna().groupBy("g2").agg(F.max("want").alias("want")), "sizes")
        top = sizes.agg(F.max("want")).first()[0] or 0
    else:
        sizes, top = None, size
    total = base.count()
    k = views or max(64, int(np.sqrt(total)))
    points = km.sample(base, "item", "v", dims, max(fit_rows, 20 * k), total)
    centers = mini_batch(points, k)
    planes = np.random.default_rng(17).standard_normal((4, dims)).astype(np.float32)
    sent = sc.broadcast((centers, merged(centers, view_cosine), planes))
    kinds = dict(base.dtypes)
    names = ["grp", "item", "score", *t[1:]]

    def see(batches):
        for b in batches:
            x, ok = km.matrix(b.column(b.schema.get_field_index("v")), dims)
            c, view_of, planes = sent.value
            view = np.where(ok, view_of[(x @ c.T).argmax(1)] if len(c) else -1, -1)
            side = ((x @ planes.T > 0) * (1 << np.arange(len(planes)))).sum(1)
            # 8 bits a value of a unit vector
            small = np.round(x * 127).astype(np.int8)
            offsets = np.arange(len(x) + 1, dtype=np.int32) * dims
            packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(small.tobytes())])
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in names], pa.array(view, pa.int32()), pa.array(side.astype(np.int32)), packed], [*names, "view", "side", "small"])

    seen = base.mapInArrow(see, ", ".join(f"{c} {kinds[c]}" for c in names) + ", view int, side int, small binary")
    # one row per item: its best score, then the smallest view and turn values
    rank = F.struct(F.col("score").isNull().alias("none"), (-F.col("score")).alias("low"), F.col("view"), *t, "small")
    once = seen.groupBy("grp", "item").agg(F.min(rank).alias("r")).select("grp", "item", "r.none", "r.low", "r.view", *[f"r.{a}" for a in t], "r.small")
    once = (once.join(sizes, F.col("grp") == F.col("g2")).drop("g2") if sizes is not None else once.withColumn("want", F.lit(size).cast("long"))).where("want > 0")
    once = materialize(once, "seen")
    strata = once.groupBy("grp", "view").agg(F.count("*").alias("n"), F.max("want").alias("want"))
    quota = quotas(strata, ["grp"], "view", F.col("want"), by).select("grp", "view", "quota", "n")
    # first come the best of every (direction, bucket, moment) of a view, then the second best, and so on
    turning = [(f"round{d}", ["grp", "view", *t[:d]], [*([f"round{d + 1}"] if d < len(t) else []), "none", "low", "item"]) for d in range(len(t), -1, -1)]
    pool, most = once.where(F.col("want") <= piece).drop("small", "want"), 8 * min(top, piece) + 64
    for place, keys, order in turning:
        pool = pool.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= most)
    pool = pool.withColumnRenamed("round0", "turn").join(quota, ["grp", "view"]).where(F.col("turn") <= 8 * F.col("quota") + F.when(F.col("quota") > 0, 64).otherwise(16))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["turn", "none", "low", "item"], kind="stable").reset_index(drop=True)
        view = pdf["view"].to_numpy()
        at, proven = chosen(_vectors(pdf.small, dims), view >= 0, view, pdf.turn.to_numpy(), pdf.quota.to_numpy(), pdf.n.to_numpy(), view_cosine)
        return pd.DataFrame({"grp": pdf.grp.iloc[0], "item": pdf["item"].to_numpy()[at], "view": view[at], "place": np.arange(1, len(at) + 1), "proven": proven})

    # vectors go to what is offered only
    offered = pool.select("grp", "item", "view", "turn", "none", "low", "quota", "n").join(once.select("grp", "item", "small"), ["grp", "item"])
    out = materialize(spread(offered, "grp").groupBy("grp").applyInPandas(choose, f"grp {kinds['grp']}, item {kinds['item']}, view int, place int, proven boolean"), "chosen")
    anew = out.where("NOT proven").select("grp").unionByName(once.where(F.col("want") > piece).select("grp")).distinct()
    out = out.where("proven").drop("proven")
    if not anew.isEmpty():
        anew = materialize(anew, "anew")
        whole = once.join(anew, "grp", "left_semi")
        ranked = whole.drop("small", "want")
        for place, keys, order in turning:
            ranked = numbered(ranked, keys, [F.col(c) for c in order], place)
        rooms = quota.groupBy("grp").agg(F.sum("quota").alias("room"), F.ceil(F.sum("n") / BLOCK).alias("blocks"))
        ranked = ranked.withColumnRenamed("round0", "turn").select("grp", "item", "view", "turn", "none", "low").join(whole.select("grp", "item", "small"), ["grp", "item"])
        ranked = ranked.join(quota.select("grp", "view", F.col("quota").alias("want")), ["grp", "view"]).join(rooms, "grp").withColumn("block", F.pmod(F.xxhash64("item"), "blocks"))
        out = out.unionByName(_rounds(materialize(ranked, "ranked"), view_cosine, dims, window, top))
    return out.withColumnsRenamed({"grp": group, "item": item})
