"""Diverse preselection: of every group a shortlist for variety and quality, in groups of any size.

What the choice needs to know of a whole group is made by aggregates: twins folded, robust quality, numbers of rows and scenes, the ranges
and champions of its signals, the sizes and ranges of its bursts. The choice itself is a walk over a pool of ranked rows. The value of a row
in the last three steps can only fall as more is chosen, so a pool of the rows of highest value is enough for as long as the best of them
stays above what the rest was worth when the pool was made. Where that ends, the values of all rows are made anew against what has been
chosen, in blocks, and the walk goes on with a new pool. A group no larger than a pool is walked at once, one that fits not at all.
For the same reason a walk compares only the rows that lead with what was chosen since they were last looked at, in matrix products.
Vectors stay away from all that is done before the walk; then they travel as bytes, and only those of groups that do not fit.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.operators.ranks import medians
from gleanframe.operators.scoring import with_stats
from gleanframe.operators.similarity import exact_twins
from gleanframe.session import col, materialize, spread

SIGNALS = ("aesthetic", "focus", "editorial", "composition", "distinctiveness")
GESTURES = ("expression", "interaction", "gesture")
VIEWS = ("whole", "subject", "context")
MATES = 32  # rows of a burst a pool holds by each rule
ROUNDING = 1e-9  # of a worth made twice
BATCH = 512  # rows of a pool that are brought up to date together
SPAN = 2048  # picks they are compared with at once
WALKED = 2**25  # values of the vectors a walk may hold


def packed(looks: DataFrame, views: Sequence[str]) -> DataFrame:
    """The lists of ``views`` as binary values with equal bytes side by side: lossless, and far smaller once compressed."""
    kinds = dict(looks.dtypes)
    wide = {v: "<f4" if kinds[v] == "array<float>" else "<f8" for v in views}
    names, schema = looks.columns, ", ".join(f"`{c}` {'binary' if c in wide else kinds[c]}" for c in looks.columns)

    def run(batches):
        for b in batches:
            out = []
            for c, x in zip(names, b.columns):
                if c in wide:
                    n, kind = len(x), np.dtype(wide[c])
                    offsets = x.offsets.to_numpy().astype(np.int64)
                    flat = x.values[offsets[0] : offsets[-1]].to_numpy(zero_copy_only=False).astype(kind)
                    sizes = np.diff(offsets)
                    data = np.empty(len(flat) * kind.itemsize, np.uint8)
                    for d in np.unique(sizes[sizes > 0]):
                        at = offsets[:-1][sizes == d] - offsets[0]
                        v = flat[at[:, None] + np.arange(d)].view(np.uint8).reshape(-1, d, kind.itemsize).transpose(0, 2, 1).reshape(len(at), -1)
                        data[at[:, None] * kind.itemsize + np.arange(d * kind.itemsize)] = v
                    ends = ((offsets - offsets[0]) * kind.itemsize).astype(np.int32)
                    known = pa.py_buffer(np.packbits(x.is_valid().to_numpy(zero_copy_only=False), bitorder="little").tobytes())
                    x = pa.Array.from_buffers(pa.binary(), n, [known, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
                out.append(x)
            yield pa.RecordBatch.from_arrays(out, names)

    return looks.mapInArrow(run, schema)


def unit_rows(values: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of a column of :func:`packed`, and which are known: a list of the common length with a finite length above 0."""
    sizes = np.fromiter((len(v) if v is not None else 0 for v in values), np.int64, len(values))
    count = Counter(sizes[sizes > 0].tolist())
    size = max(sorted(count), key=count.__getitem__) if count else 0
    wide = np.dtype(kind).itemsize
    x = np.zeros((len(values), size // wide or 1))
    at = np.flatnonzero(sizes == size) if size else np.zeros(0, np.int64)
    for i in range(0, len(at), 4096):
        part = at[i : i + 4096]
        raw = np.frombuffer(b"".join(values[part].tolist()), np.uint8).reshape(len(part), wide, -1)
        x[part] = np.ascontiguousarray(raw.transpose(0, 2, 1)).view(kind)[:, :, 0]
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    known = np.isfinite(norm) & (norm > 0)
    x[~known] = 0
    x /= np.where(known, norm, 1)[:, None]
    return x, known


def likeness(views: Sequence[tuple[np.ndarray, np.ndarray]], rows: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """How alike rows are to picks, both by position: the least cosine over the views both have, -1 where there is none."""
    out = np.full((len(rows), len(picks)), np.inf)
    for x, known in views:
        both = known[rows][:, None] & known[picks]
        np.minimum(out, x[rows] @ x[picks].T, out=out, where=both)
    out[np.isinf(out)] = -1.0
    return np.clip(out, -1.0, 1.0, out=out)


def nearest(views: Sequence[tuple[np.ndarray, np.ndarray]], rows: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """The greatest likeness of every row to the picks, -1 where it has none."""
    out = np.full(len(rows), -1.0)
    if len(views) != 1:
        for i in range(0, len(rows), BATCH):
            for j in range(0, len(picks), SPAN):
                out[i : i + BATCH] = np.maximum(out[i : i + BATCH], likeness(views, rows[i : i + BATCH], picks[j : j + SPAN]).max(1, initial=-1.0))
        return out
    (x, known), = views
    picks, at = picks[known[picks]], np.flatnonzero(known[rows])
    for j in range(0, len(picks), SPAN):
        y = x[picks[j : j + SPAN]].T
        for i in range(0, len(at), BATCH):
            part = at[i : i + BATCH]
            out[part] = np.maximum(out[part], (x[rows[part]] @ y).max(1))
    return np.minimum(out, 1.0)


def plan(n_scenes: int, cap: int, share: float, explore: int, strict: bool) -> tuple[int, int, int, int]:
    """The sizes of the steps: all slots, those for scenes, for quality, and for exploration. Halves are rounded to even."""
    cap = cap if strict else max(cap, n_scenes)
    scenes = min(n_scenes, max(1, round(0.35 * cap))) if strict else n_scenes
    far = min(max(0, explore), max(0, cap - scenes - 1))
    return cap, scenes, min(cap - far, max(scenes, round(cap * share))), far


class Walk:
    """One group's choice over a pool ``q`` (columns by name) in rank order, going on from positions, steps and reasons chosen before.

    ``limit`` holds the worth of the best row outside the pool for coverage and exploration, and of each burst for its poses (-inf: none).
    ``closest`` holds how alike a row is to the first ``met`` of the picks, ``in_burst`` to the first ``folded`` ones of its burst.
    """

    def __init__(self, q: dict[str, np.ndarray], facts: dict, views: list, limit: dict) -> None:
        self.q, self.facts, self.views, self.limit = q, facts, views, limit
        n = len(q["item"])
        self.out: list[tuple[int, str, str]] = []
        self.given, self.done = 0, Counter()
        self.picked = np.zeros(n, np.int64)
        self.quality, self.apart, self.unsure = (q[c].astype(float) for c in ("quality", "apart", "uncertainty"))
        seen = np.any([k for _, k in views], axis=0) if views else np.zeros(n, bool)
        self.closest = np.where(seen, -1.0, 1.0)
        # a row without a vector is never new, so it need not be compared
        self.met = np.where(seen, 0, n + 1)
        self.free = np.ones(n, bool)
        self.burst = q["block"]
        self.moment = pd.factorize(q["place_of"])[0] if n else np.zeros(0, int)
        self.open_moment = np.ones(self.moment.max() + 1 if n else 0, bool)

    def take(self, i: int, step: str, why: str) -> None:
        self.picked[len(self.out)] = i
        self.free[i] = False
        self.open_moment[self.moment[i]] = False
        self.done[step] += 1
        self.out.append((i, step, why))

    def meet(self, rows: np.ndarray) -> None:
        """Compares rows with picks they have not met, at most ``SPAN`` of them."""
        rows = rows[self.met[rows] < len(self.out)]
        rows = rows[np.argsort(self.met[rows], kind="stable")]
        cuts = np.flatnonzero(np.diff(self.met[rows])) + 1
        if len(cuts) > 16:
            cuts = np.arange(1, 16) * len(rows) // 16
        for part in np.split(rows, cuts):
            if len(part):
                since = int(self.met[part[0]])
                to = min(len(self.out), since + SPAN)
                self.closest[part] = np.maximum(self.closest[part], nearest(self.views, part, self.picked[since:to]))
                self.met[part] = np.maximum(self.met[part], to)

    # ---- the steps, each True when it is over, False when the pool no longer proves its choice ----

    def scenes(self, slots: int) -> bool:
        for i in np.flatnonzero(~pd.Series(self.q["scene"]).duplicated().to_numpy())[:slots]:
            self.take(int(i), "scene", "scene representative")
        return True

    def champions(self, quota: int) -> bool:
        for name in SIGNALS:
            best = self.facts["champions"].get(name)
            if best is None or len(self.out) >= quota:
                continue
            i = int(np.flatnonzero(self.q["item"] == best)[0])
            if self.free[i]:
                self.take(i, "champion", f"champion: {name}")
        return True

    def protected(self, quota: int) -> bool:
        for i in np.flatnonzero(self.free)[: max(0, quota - len(self.out))]:
            self.take(int(i), "protected", "protected quality")
        return True

    def bursts(self, turns: int) -> bool:
        """Bursts of two or more in turn: the least used for their size, then the best, then the smaller first item."""
        order = np.argsort(self.burst, kind="stable")
        order = order[self.burst[order] >= 0]
        heads, folded, lately = {}, Counter(), Counter()
        for mates in np.split(order, np.flatnonzero(np.diff(self.burst[order])) + 1) if len(order) else []:
            first = mates[0]
            if self.q["b_size"][first] > 1:
                heads[int(self.burst[first])] = (int(self.q["b_size"][first]), float(self.q["b_top"][first]), self.q["b_first"][first], mates)
        had_of = {b: [] for b in heads}
        for i, s, _ in self.out:
            if (b := int(self.burst[i])) in heads:
                had_of[b].append(i)
        in_burst = np.full(len(self.burst), -1.0)
        queue = [(len(had_of[b]) / s, -t, f, b) for b, (s, t, f, _) in heads.items() if len(had_of[b]) < s]
        heapq.heapify(queue)
        while self.done["burst"] < turns and queue:
            b = queue[0][3]
            size, top, first, mates = heads[b]
            had, rest = had_of[b], mates[self.free[mates]]
            if not len(rest) or (len(mates) < size and lately[b] >= MATES - 2):
                return False
            turn = len(had) % 3
            won = self.challenge(rest, np.array(had)) if turn == 1 else None
            if not had:
                i, why = int(rest[0]), "burst representative"
            elif won is not None:
                i, why = won[0], f"burst alternative: {won[1]}"
            elif turn == 0:
                i, why = int(rest[0]), "burst alternative: quality"
            else:
                in_burst[rest] = np.maximum(in_burst[rest], nearest(self.views, rest, np.array(had[folded[b] :])))
                folded[b] = len(had)
                worth = (0.35 + 0.65 * self.quality[rest]) * np.sqrt((1 - in_burst[rest]) / 2)
                at = int(np.argmax(worth))
                if worth[at] < self.limit["pose"].get(b, -np.inf) - ROUNDING:
                    return False
                i, why = int(rest[at]), "burst alternative: pose" if worth[at] > 1e-5 else "burst alternative: quality"
            self.take(i, "burst", why)
            had.append(i)
            lately[b] += 1
            if len(had) < size:
                heapq.heapreplace(queue, (len(had) / size, -top, first, b))
            else:
                heapq.heappop(queue)
        return True

    def challenge(self, rest: np.ndarray, had: np.ndarray) -> tuple[int, str] | None:
        """The row of a burst that beats all chosen ones in a gesture by the greatest share of the burst's range."""
        best = None
        for name in GESTURES:
            if name not in self.q:
                continue
            v = self.q[name].astype(float)
            low, wide = self.q[f"low_{name}"][rest[0]], self.q[f"wide_{name}"][rest[0]]
            prior = v[had][np.isfinite(v[had])]
            if low is None or wide is None or not (wide >= 0.005) or not len(prior):
                continue
            for i in rest:
                if np.isfinite(v[i]) and v[i] > prior.max():
                    key = ((v[i] - prior.max()) / wide, self.quality[i], -int(i))
                    if best is None or key > best[0]:
                        best = (key, int(i), name)
        return best and best[1:]

    def greedy(self, step: str, until: int, worth, why) -> bool:
        """Takes the row of greatest worth, of equal ones the best ranked, again and again.

        A worth can only fall as more is taken, so what it was when a row was last compared bounds it. The rows of greatest bound are brought
        up to date and walked for as long as the best of them stands before the bound of all others.
        """
        while len(self.out) < until:
            free = np.flatnonzero(self.free)
            if not len(free):
                return False
            bound, rows, beyond = worth(free), free, (np.inf, 0)
            if len(free) > BATCH:
                cut = np.argpartition(-bound, BATCH)
                rows, others = np.sort(free[cut[:BATCH]]), cut[BATCH:]
                most = bound[others].max()
                beyond = (-most, int(free[others[bound[others] == most]].min()))
            left = np.ones(len(rows), bool)
            local = [(x[rows], known[rows]) for x, known in self.views]
            while len(self.out) < until:
                value = np.where(left, worth(rows), -np.inf)
                at = int(np.argmax(value))
                i = int(rows[at])
                if not left[at] or (-value[at], i) > beyond:
                    break
                if self.met[i] < len(self.out):
                    self.meet(rows[left & (value >= -beyond[0])])
                    continue
                if value[at] < self.limit[step] - ROUNDING:
                    return False
                told = why(i)
                now = self.met[rows] == len(self.out)
                self.take(i, step, told)
                left[at] = False
                like = np.full(len(rows), np.inf)
                for x, known in local:
                    if known[at]:
                        np.minimum(like, x @ x[at], out=like, where=known)
                like = np.clip(np.where(np.isinf(like), -1.0, like), -1.0, 1.0)
                self.closest[rows] = np.maximum(self.closest[rows], like)
                self.met[rows[now]] += 1
        return True

    def coverage(self, until: int) -> bool:
        fresh = lambda rows: self.open_moment[self.moment[rows]]
        return self.greedy("coverage", until, lambda rows: coverage_worth(self.quality[rows], self.closest[rows], fresh(rows)), lambda i: "new moment" if fresh(i) else "coverage")

    def explore(self, until: int) -> bool:
        return self.greedy("explore", until, lambda rows: explore_worth(self.closest[rows], self.apart[rows], self.unsure[rows]), lambda i: "exploration")


def coverage_worth(quality, closest, fresh):
    new = np.sqrt(np.maximum(1 - closest, 0) / 2)
    return quality * (0.15 + 0.85 * new + 0.3 * fresh * new)


def explore_worth(closest, apart, unsure):
    return 0.7 * (1 - closest) / 2 + 0.2 * apart + 0.1 * unsure


def walk(w: Walk, before: list, cap: int, share: float, explore: int, strict: bool, bursts: bool) -> bool:
    """Runs the steps from where ``before`` ends; True once the group's choice is complete."""
    for i, step, why in before:
        w.take(i, step, why)
    w.given = len(before)
    cap, scenes, quota, far = plan(w.facts["n_scenes"], cap, share, explore, strict)
    if not before:
        w.scenes(scenes)
        w.champions(quota)
        if bursts:
            w.protected(quota)
    turns = max(0, min(round(0.4 * cap), cap - (len(w.out) - w.done["burst"] - w.done["coverage"] - w.done["explore"]) - far)) if bursts else 0
    at = {"burst": 0, "coverage": 1, "explore": 2}.get(before[-1][1] if before else "", 0)
    if at == 0 and bursts and not w.bursts(turns):
        return False
    return w.coverage(cap - far) and w.explore(cap) if at <= 1 else w.explore(cap)


# ---- what the walk needs to know of whole groups --------------------------------------------------------------------------------------


def _known(c: Column) -> Column:
    x = c.cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def prepared(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of :func:`diverse_preselection` with twins folded, their quality and the facts of their group and burst."""
    signals = [s for s in SIGNALS if s in rows.columns]
    gestures = [s for s in GESTURES if s in rows.columns]
    r = rows.withColumn("score", _known(F.col("score"))).where("item IS NOT NULL AND score IS NOT NULL").dropDuplicates([*keys, "item"])
    if "digest" in rows.columns:
        kept = exact_twins(r, "item", "digest", "score", keys).where("item = keeper").select(*[F.col(k).alias(f"tw_{k}") for k in keys], F.col("item").alias("tw_item"))
        r = r.join(kept, [F.col(k).eqNullSafe(F.col(f"tw_{k}")) for k in keys] + [F.col("item") == F.col("tw_item")], "left_semi")
    burst = F.coalesce(F.col("burst"), F.lit(-1)) if "burst" in rows.columns else F.lit(-1)
    r = r.withColumn("block", F.when(burst >= 0, F.xxhash64(*keys, "scene", burst).bitwiseAND(F.lit(2**63 - 1))).otherwise(-1).cast("long"))
    r = r.withColumn("place_of", F.xxhash64("scene", "moment" if "moment" in rows.columns else "scene"))
    for s in [*signals, *gestures]:
        r = r.withColumn(s, _known(F.col(s)))
    r = r.withColumn("uncertainty", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(_known(F.col("uncertainty")) if "uncertainty" in rows.columns else F.lit(0.0), F.lit(0.0)))))
    # the logistic of the distance from the median over the robust scale
    r = materialize(r, "clean")
    key_join = lambda a, b: a.join(b.withColumnsRenamed({k: f"kj_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"kj_{k}")) for k in keys], "left").drop(*[f"kj_{k}" for k in keys])
    # only the scores go through the medians; all columns meet both at once
    scores = r.select(*keys, "score")
    center = medians(scores, keys, "score", "mid")
    spreads = medians(key_join(scores, center).select(*keys, F.abs(F.col("score") - F.col("mid")).alias("off")), keys, "off", "mad")
    r = key_join(r, key_join(center, spreads))
    x = (F.col("score") - F.col("mid")) / F.greatest(1.4826 * F.col("mad"), F.lit(1.0))
    r = r.withColumn("quality", 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0))))).drop("mid", "mad")
    r = materialize(r, "quality")
    scenes = r.groupBy(*keys, "scene").agg(F.count("*").alias("c")).groupBy(*keys).agg(F.count("*").alias("n_scenes"))
    rank = F.struct((-F.col("score")).alias("s"), F.col("item").alias("i"))
    facts = {"n": F.count("*"), "any_burst": F.max(F.col("block") >= 0)}
    for s in signals:
        v = F.col(s) * F.col("quality") if s == "distinctiveness" else F.col(s)
        facts[f"lo_{s}"], facts[f"hi_{s}"] = F.min(v), F.max(v)
        # the greatest value, of equal ones the best ranked
        facts[f"ch_{s}"] = F.min(F.when(v.isNotNull(), F.struct((-v).alias("v"), rank.alias("r"))))
        if s != "distinctiveness":
            facts[f"mn_{s}"], facts[f"mx_{s}"] = F.min(s), F.max(s)
    r = key_join(with_stats(r, keys, **facts), scenes)
    apart = [F.when(F.col(f"mx_{s}") - F.col(f"mn_{s}") > 1e-6, F.abs((F.col(s) - F.col(f"mn_{s}")) / (F.col(f"mx_{s}") - F.col(f"mn_{s}")) - F.col("quality"))) for s in signals if s != "distinctiveness"]
    r = r.withColumn("apart", F.coalesce(F.greatest(*apart, F.lit(0.0)) if apart else F.lit(0.0), F.lit(0.0)))
    for s in signals:
        r = r.withColumn(f"ch_{s}", F.when(F.col(f"hi_{s}") - F.col(f"lo_{s}") > 1e-6, F.col(f"ch_{s}.r.i")))
    r = r.drop(*[f"{p}_{s}" for p in ("lo", "hi", "mn", "mx") for s in signals])
    burst_facts = {"b_size": F.count("*"), "b_top": F.max("quality"), "b_first": F.min(rank)["i"]}
    for s in gestures:
        burst_facts[f"low_{s}"], burst_facts[f"wide_{s}"] = F.min(s), F.when(F.count(s) >= 2, F.max(s) - F.min(s))
    of = r.where("block >= 0").groupBy(F.col("block").alias("b_block")).agg(*[a.alias(n) for n, a in burst_facts.items()])
    return r.join(of, F.col("block") == F.col("b_block"), "left").drop("b_block")


def grouped(frames: Iterable[pd.DataFrame], keys: Sequence[str]) -> Iterator[dict[str, np.ndarray]]:
    """The groups, columns by name, of frames that come sorted by their keys; NULL keys form a group of their own."""
    held: list[dict] = []
    whole = lambda: {c: np.concatenate([h[c] for h in held]) for c in held[0]} if len(held) > 1 else held[0]
    same = lambda a, b: a == b or (pd.isna(a) and pd.isna(b))
    for pdf in frames:
        if not len(pdf):
            continue
        cols = {c: pdf[c].to_numpy() for c in pdf.columns}
        new = np.zeros(len(pdf), bool)
        for k in keys:
            codes = pd.factorize(pdf[k], use_na_sentinel=False)[0]
            new[1:] |= codes[1:] != codes[:-1]
        new[0] = bool(held) and not all(same(held[-1][k][-1], cols[k][0]) for k in keys)
        start = 0
        for end in np.flatnonzero(new):
            if end > start:
                held.append({c: v[start:end] for c, v in cols.items()})
            yield whole()
            held, start = [], end
        held.append({c: v[start:] for c, v in cols.items()})
    if held:
        yield whole()


def diverse_preselection(
    rows: DataFrame, keys: Sequence[str], cap: str | int, strict: bool = False, share: float | None = None, explore: int = 2, pool_rows: int | None = None, block_rows: int = 20_000,
    looks: DataFrame | None = None,
) -> DataFrame:
    """``keys, item, place, reason``: of every group ``cap`` rows (a number or a column), in the order they were chosen.

    ``rows`` has ``keys, item, score, scene`` and may have ``burst, moment, digest``, the signals, gestures, ``uncertainty``, and vectors
    ``whole`` (or ``clip``, used in groups without any ``whole``), ``subject`` and ``context``. Not ``strict``, a group has a slot for every
    scene at least. Twins are folded first; a group that fits is taken whole ("all fit"). Else in turn: the best of each scene; the champion
    of each signal that varies, unless taken; in groups with bursts the best by rank; alternatives inside bursts; what is good and looks
    unlike all taken, a moment not yet shown counting more; and what is least alike, or judged differently by its signals.

    The vectors may come by themselves in ``looks`` (``item, look`` and the vectors), where ``look`` in ``rows`` tells an item's versions
    apart. Groups of more than ``pool_rows`` rows, by default as many as a walk may hold by their vectors, go through pools; the choice is
    the same for any number.

    Defined cases: rows without item or score do not count; an item given again counts once; a row without a vector is never new; equal
    values go by rank (score, then smaller item); an empty table gives no rows.
    """
    kinds = dict(rows.dtypes)
    views = [v for v in ("whole", "clip", *VIEWS[1:]) if v in (rows if looks is None else looks).columns]
    if views and looks is None:
        rows = materialize(rows.withColumn("look", F.xxhash64(*views)), "rows")
        looks = rows.select("item", "look", *views)
    widths = {v: "<f4" if dict(looks.dtypes)[v] == "array<float>" else "<f8" for v in views}
    r = rows.drop(*views).withColumn("cap_of", F.lit(cap) if isinstance(cap, int) else F.col(cap).cast("int"))
    r = prepared(r, keys)
    pool_columns = [c for c in r.columns if c in {*keys, "item", "look", "score", "scene", "block", "place_of", "quality", "apart", "uncertainty", "cap_of", "n", "n_scenes", "any_burst", "b_size", "b_top", "b_first", *GESTURES} or c.startswith(("ch_", "low_", "wide_"))]
    r = materialize(r.select(*pool_columns), "prepared")
    names = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    schema = f"{names}, item {kinds['item']}, place int, step string, reason string, complete boolean"

    def run(q: dict[str, np.ndarray]) -> pd.DataFrame:
        first = lambda c: q[c][0] if c in q and not pd.isna(q[c][0]) else None
        whole = "whole" if first("any_whole") or "clip" not in q else "clip"
        seen = [unit_rows(q[v], widths[v]) for v in (whole, *VIEWS[1:]) if v in q]
        champions = {s: first(f"ch_{s}") for s in SIGNALS if first(f"ch_{s}") is not None}
        facts = {"n": int(q["n"][0]), "n_scenes": int(q["n_scenes"][0]), "champions": champions}
        bound = lambda c: -np.inf if first(c) is None else float(first(c))
        poses = {int(b): float(p) for b, p in zip(q["block"], q["pose_bound"]) if not pd.isna(p)} if "pose_bound" in q else {}
        w = Walk(q, facts, seen, {"coverage": bound("cover_bound"), "explore": bound("explore_bound"), "pose": poses})
        bursts = bool(q["any_burst"][0])
        part = (0.4 if bursts else 0.5) if share is None else share
        before = []
        if "had" in q:
            had = q["had"].astype(float)
            at = np.flatnonzero(~np.isnan(had))
            before = [(int(i), q["step"][i], q["why"][i]) for i in at[np.argsort(had[at])]]
        complete = walk(w, before, int(q["cap_of"][0]), part, explore, strict, bursts)
        at = [i for i, _, _ in w.out]
        return pd.DataFrame({**{k: q[k][at] for k in keys}, "item": q["item"][at], "place": np.arange(1, len(at) + 1), "step": [s for _, s, _ in w.out], "reason": [t for _, _, t in w.out], "complete": complete})

    def walks(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for q in grouped(frames, keys):
            held.append(run(q))
            n += len(held[-1])
            if n > 10_000:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    choose = lambda d: spread(d, *keys).sortWithinPartitions(*[col(k) for k in keys], F.desc("score"), "item").mapInPandas(walks, schema)
    fits = F.coalesce(F.col("n") <= (F.col("cap_of") if strict else F.greatest("cap_of", "n_scenes")), F.lit(False))
    out = r.where(fits).select(*keys, "item", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "item")).alias("place"), F.lit("all fit").alias("reason"))
    rest = r.where(~fits)
    most = rest.agg(F.max("n")).first()[0] or 0
    if pool_rows is None:
        pool_rows = 20_000
        if views and most > pool_rows:
            dims = sum(d or 0 for d in looks.agg(*[F.max(F.size(v)) for v in views]).first())
            pool_rows = max(pool_rows, WALKED // max(dims, 1))
        elif not views:
            pool_rows = WALKED // 64

    def seen_rows(d: DataFrame) -> DataFrame:
        """With their vectors, which rows given again hold again."""
        if not views:
            return d.drop("look")
        d = d.join(packed(looks.select("item", "look", *views).where("item IS NOT NULL"), views), ["item", "look"], "left")
        d = d.dropDuplicates([*keys, "item", "look"]).drop("look")
        return with_stats(d, keys, any_whole=F.max(F.coalesce(F.length("whole") > 0, F.lit(False)))) if {"whole", "clip"} <= {*views} else d

    out = out.unionByName(choose(seen_rows(rest.where(F.col("n") <= pool_rows))).select(*keys, "item", "place", "reason"))
    if most <= pool_rows:
        return out
    large = materialize(seen_rows(rest.where(F.col("n") > pool_rows)), "large")
    picks = None
    while True:
        got = materialize(choose(_pool(large, picks, keys, widths, strict, pool_rows, block_rows)), "picks")
        out = out.unionByName(got.where("complete").select(*keys, "item", "place", "reason"))
        picks = got.where("NOT complete")
        if picks.isEmpty():
            return out
        large = large.join(picks.select(*keys).distinct(), list(keys), "left_semi")


def _pool(rows: DataFrame, picks: DataFrame | None, keys: Sequence[str], views: dict[str, str], strict: bool, pool_rows: int, block_rows: int) -> DataFrame:
    """Rows of large groups a walk may need next, with the worth of the best row left out for each of its last steps."""
    slots = F.greatest("cap_of", F.lit(1) if strict else F.col("n_scenes"))
    if picks is None:
        nov = F.lit(1.0)
        has = F.lit(False)
        for v in views:
            has = has | F.coalesce(F.length(v) > 0, F.lit(False))
        nov = F.when(has, 1.0).otherwise(0.0)
        r = rows.withColumn("cover", F.col("quality") * (0.15 + 1.15 * nov)).withColumn("far", 0.7 * nov + 0.2 * F.col("apart") + 0.1 * F.col("uncertainty")).withColumn("pose", 0.35 + 0.65 * F.col("quality"))
        r = r.withColumn("had", F.lit(None).cast("int")).withColumn("step", F.lit(None).cast("string")).withColumn("why", F.lit(None).cast("string"))
    else:
        r = _worth(rows, picks, keys, views, block_rows)
    r = materialize(r, "worth")
    m = pool_rows // 8
    rank = [F.desc("score"), F.col("item")]
    top = lambda d, part, order, k, out: d.withColumn(out, F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col(out) <= k)
    ids = [*keys, "item"]
    free = r.where("had IS NULL")
    cover, far = top(free, keys, [F.desc("cover"), *rank], m, "t"), top(free, keys, [F.desc("far"), *rank], m, "t")
    best = top(free, keys, rank, F.greatest(F.lit(m), slots), "t")
    scenes = top(top(r, [*keys, "scene"], rank, 1, "u"), keys, rank, slots, "t")
    champions = r.where(F.col("item").isin(*[F.col(c) for c in r.columns if c.startswith("ch_")])) if any(c.startswith("ch_") for c in r.columns) else r.limit(0)
    # bursts with something chosen, and of the others the best by their best member; a few rows of each by every rule
    groups = r.where("block >= 0 AND b_size > 1").groupBy(*keys, "block", "b_top", "b_first").agg(F.max(F.col("had").isNotNull()).alias("used"), F.max(slots).alias("slots"))
    ready = groups.withColumn("t", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("used"), F.desc("b_top"), "b_first"))).where(F.col("t") <= 2 * F.col("slots")).select("block")
    mates = free.join(ready, "block", "left_semi")
    by = [rank, [F.desc("pose"), *rank], *[[F.desc_nulls_last(g), *rank] for g in GESTURES if g in r.columns]]
    few = [top(mates, ["block"], order, MATES, "t") for order in by]
    wanted = r.where("had IS NOT NULL").select(*ids)
    for part in (cover, far, best, scenes, champions, *few):
        wanted = wanted.unionByName(part.select(*ids))
    pool = r.join(wanted.distinct(), ids, "left_semi")
    # all rows outside are worth at most what the last inside is; without an outside there is no bound
    ends = cover.groupBy(*keys).agg(F.when(F.count("*") >= m, F.min("cover")).alias("cover_bound")).join(far.groupBy(*keys).agg(F.when(F.count("*") >= m, F.min("far")).alias("explore_bound")), list(keys))
    poses = few[1].groupBy("block").agg(F.when(F.count("*") >= MATES, F.min("pose")).alias("pose_bound"))
    return pool.join(ends, list(keys), "left").join(poses, "block", "left").drop("cover", "far", "pose")


def _worth(rows: DataFrame, picks: DataFrame, keys: Sequence[str], views: dict[str, str], block_rows: int) -> DataFrame:
    """The rows with their worth against the picks of their group (a bounded set that goes to every block of it)."""
    mine = picks.select(*keys, "item", F.col("place").alias("had"), "step", F.col("reason").alias("why"))
    r = rows.join(mine, [*keys, "item"], "left").withColumn("wo_block", F.pmod(F.xxhash64("item"), F.ceil(F.col("n") / block_rows).cast("int")))
    held = r.where("had IS NOT NULL")
    away = held.withColumn("wo_block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block_rows).cast("int") - 1))).withColumn("wo_pick", F.lit(True))
    both = r.withColumn("wo_pick", F.lit(False)).unionByName(away)
    fields = [*r.columns]
    ddl = ", ".join(f"`{c}` {t}" for c, t in r.dtypes) + ", cover double, far double, pose double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("wo_pick", kind="stable").reset_index(drop=True)
        k = int((~pdf.wo_pick).sum())
        whole = "whole" if bool(pdf.get("any_whole", pd.Series([False])).iloc[0]) or "clip" not in pdf else "clip"
        seen = [unit_rows(pdf[v].to_numpy(), views[v]) for v in (whole, *VIEWS[1:]) if v in pdf]
        rows, chosen = np.arange(k), np.arange(k, len(pdf))
        closest = np.ones(len(pdf))
        if seen:
            closest[:k] = np.where(np.any([x for _, x in seen], axis=0)[:k], nearest(seen, rows, chosen), 1.0)
        mates = np.full(len(pdf), -1.0)
        block = pdf.block.to_numpy()
        for b in np.unique(block[k:][block[k:] >= 0]) if seen else []:
            same = np.flatnonzero(block[:k] == b)
            mates[same] = nearest(seen, same, chosen[block[k:] == b])
        fresh = ~pdf.place_of.isin(pdf.place_of[k:]).to_numpy()
        q = pdf.quality.to_numpy(float)
        out = pdf[fields].assign(cover=coverage_worth(q, closest, fresh), far=explore_worth(closest, pdf.apart.to_numpy(float), pdf.uncertainty.to_numpy(float)), pose=(0.35 + 0.65 * q) * np.sqrt((1 - mates) / 2))
        return out.iloc[:k]

    return spread(both, *keys, "wo_block").groupBy(*keys, "wo_block").applyInPandas(run, ddl).drop("wo_block")
