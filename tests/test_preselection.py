"""Diverse preselection against a plain walk over Python rows, whole and with pools far smaller than the groups, and its cases."""

from __future__ import annotations

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanframe.operators import preselection
from gleanframe.operators.preselection import diverse_preselection

DDL = (
    "grp string, item string, score double, scene int, moment int, burst int, digest string, whole array<double>, subject array<double>, context array<double>, aesthetic double, "
    "focus double, editorial double, composition double, distinctiveness double, uncertainty double, expression double, interaction double, gesture double, cap int"
)
NAMES = [c.split()[0] for c in DDL.split(", ")]


def row(item, **how):
    base = dict.fromkeys(NAMES)
    return {**base, "grp": "g", "item": item, "score": 0.0, "scene": 0, "moment": 0, "burst": -1, "cap": 10, **how}


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in NAMES) for r in rows], DDL)


def chosen(spark, rows, **how):
    out = diverse_preselection(frame(spark, rows), ["grp"], "cap", **how).collect()
    return {g: [(r["item"], r["reason"]) for r in sorted((r for r in out if r["grp"] == g), key=lambda r: r["place"])] for g in {r["grp"] for r in out}}


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


def plainly(rows, strict=False, explore=2):
    """The rules one after another, on Python lists."""
    best = {}
    for r in rows:
        k = r["digest"] or r["item"]
        if k not in best or (-r["score"], r["item"]) < (-best[k]["score"], best[k]["item"]):
            best[k] = r
    rows = sorted(best.values(), key=lambda r: (-r["score"], r["item"]))
    n, cap = len(rows), rows[0]["cap"]
    scenes = {r["scene"] for r in rows}
    bursting = any(r["burst"] is not None and r["burst"] >= 0 for r in rows)
    share = 0.4 if bursting else 0.5
    cap = cap if strict else max(cap, len(scenes))
    if n <= cap:
        return [(r["item"], "all fit") for r in rows]
    slots = min(len(scenes), max(1, round(0.35 * cap))) if strict else len(scenes)
    far = min(explore, max(0, cap - slots - 1))
    quota = min(cap - far, max(slots, round(cap * share)))
    mid = statistics.median(r["score"] for r in rows)
    mad = statistics.median(abs(r["score"] - mid) for r in rows)
    quality = [1 / (1 + math.exp(-max(-30, min(30, (r["score"] - mid) / max(1.4826 * mad, 1))))) for r in rows]
    out, taken = [], {}

    def sim(i, j):
        c = [cosine(rows[i][v], rows[j][v]) for v in ("whole", "subject", "context") if rows[i][v] and rows[j][v]]
        return max(-1, min(1, min(c))) if c else -1.0

    def close(i, mates=None):
        start = -1.0 if any(rows[i][v] for v in ("whole", "subject", "context")) else 1.0
        if mates is not None:
            start = -1.0
        return max([start] + [sim(j, i) for j in taken if mates is None or j in mates])

    def take(i, why):
        taken[i] = why
        out.append((rows[i]["item"], why))

    seen = set()
    for i, r in enumerate(rows):
        if r["scene"] not in seen and len(seen) < slots:
            seen.add(r["scene"])
            take(i, "scene representative")
    for s in ("aesthetic", "focus", "editorial", "composition", "distinctiveness"):
        v = {i: r[s] * (quality[i] if s == "distinctiveness" else 1) for i, r in enumerate(rows) if r[s] is not None and math.isfinite(r[s])}
        if len(out) < quota and v and max(v.values()) - min(v.values()) > 1e-6:
            i = max(v, key=lambda i: (v[i], -i))
            if i not in taken:
                take(i, f"champion: {s}")
    if bursting:
        for i in range(n):
            if i not in taken and len(out) < quota:
                take(i, "protected quality")
        groups = {}
        for i, r in enumerate(rows):
            if r["burst"] is not None and r["burst"] >= 0:
                groups.setdefault((r["scene"], r["burst"]), []).append(i)
        groups = [g for g in groups.values() if len(g) > 1]
        for _ in range(min(round(0.4 * cap), cap - len(out) - far)):
            ready = [g for g in groups if any(i not in taken for i in g)]
            if not ready:
                break
            g = min(ready, key=lambda g: (sum(i in taken for i in g) / len(g), -max(quality[i] for i in g), rows[g[0]]["item"]))
            had, free = [i for i in g if i in taken], [i for i in g if i not in taken]
            if not had:
                take(free[0], "burst representative")
                continue
            told = []
            if len(had) % 3 == 1:
                for s in ("expression", "interaction", "gesture"):
                    v = {i: rows[i][s] for i in g if rows[i][s] is not None and math.isfinite(rows[i][s])}
                    prior = [v[i] for i in had if i in v]
                    if len(v) > 1 and max(v.values()) - min(v.values()) >= 0.005 and prior:
                        told += [((v[i] - max(prior)) / (max(v.values()) - min(v.values())), quality[i], -i, s) for i in free if i in v and v[i] > max(prior)]
            if told:
                best = max(told, key=lambda t: t[:3])
                take(-best[2], f"burst alternative: {best[3]}")
            elif len(had) % 3 == 0:
                take(free[0], "burst alternative: quality")
            else:
                worth = {i: (0.35 + 0.65 * quality[i]) * math.sqrt((1 - close(i, set(g))) / 2) for i in free}
                i = max(worth, key=lambda i: (worth[i], -i))
                take(i, "burst alternative: pose" if worth[i] > 1e-5 else "burst alternative: quality")
    while len(out) < cap - far:
        shown = {(rows[i]["scene"], rows[i]["moment"]) for i in taken}
        worth = {}
        for i, r in enumerate(rows):
            if i not in taken:
                new = math.sqrt(max(0, 1 - close(i)) / 2)
                worth[i] = quality[i] * (0.15 + 0.85 * new + (0.3 * new if (r["scene"], r["moment"]) not in shown else 0))
        i = max(worth, key=lambda i: (worth[i], -i))
        take(i, "coverage" if (rows[i]["scene"], rows[i]["moment"]) in shown else "new moment")
    apart = [0.0] * n
    for s in ("aesthetic", "focus", "editorial", "composition"):
        v = {i: r[s] for i, r in enumerate(rows) if r[s] is not None and math.isfinite(r[s])}
        if v and max(v.values()) - min(v.values()) > 1e-6:
            for i, x in v.items():
                apart[i] = max(apart[i], abs((x - min(v.values())) / (max(v.values()) - min(v.values())) - quality[i]))
    while len(out) < cap:
        worth = {i: 0.7 * (1 - close(i)) / 2 + 0.2 * apart[i] + 0.1 * max(0, min(1, r["uncertainty"] or 0)) for i, r in enumerate(rows) if i not in taken}
        take(max(worth, key=lambda i: (worth[i], -i)), "exploration")
    return out


def random_rows(seed, n=160, cap=24, bursts=True, grp="g"):
    r, g = random.Random(seed), np.random.default_rng(seed)
    looks = g.standard_normal((12, 6))
    maybe = lambda x, p=0.1: None if r.random() < p else x
    view = lambda: maybe((looks[min(r.randrange(12), r.randrange(12))] + 0.2 * g.standard_normal(6)).tolist())
    return [
        row(
            f"{grp}{i:04}", grp=grp, score=round(r.gauss(0, 2), 3), scene=r.randrange(5), moment=r.randrange(4), burst=r.choice([-1, None, 0, 1, 2]) if bursts else -1,
            digest=r.choice(["", None, None, f"d{r.randrange(60)}"]), whole=view(), subject=maybe(g.standard_normal(6).tolist(), 0.6), context=maybe(g.standard_normal(6).tolist(), 0.9), cap=cap,
            **{s: maybe(float("nan") if r.random() < 0.05 else r.random(), 0.2) for s in ("aesthetic", "focus", "editorial", "composition", "distinctiveness", "expression", "interaction", "gesture")},
            uncertainty=maybe(r.uniform(-0.5, 1.5), 0.3),
        )
        for i in range(n)
    ]


@pytest.mark.parametrize("strict, bursts", [(False, True), (True, False)])
def test_equals_a_plain_walk_whatever_the_pool(spark, strict, bursts):
    """Groups of several sizes at once; the pools of the second run hold a few rows of a group, so many rounds are taken."""
    rows = random_rows(1, 160, 24, bursts) + random_rows(2, 90, 30, bursts, "h") + random_rows(3, 12, 20, bursts, "k") + random_rows(4, 70, 3, bursts, "m")
    want = {g: plainly([r for r in rows if r["grp"] == g], strict) for g in "ghkm"}
    assert chosen(spark, rows + rows[:20], strict=strict) == want
    assert chosen(spark, rows, strict=strict, pool_rows=40, block_rows=30) == want


def test_an_action_survives_and_bad_pans_do_not(spark):
    rows = [row(f"i{i:03}", score=1.0, whole=[1.0, 0.001 * i], cap=15) for i in range(20)] + [row("i020", score=0.8, whole=[0.0, 1.0], cap=15)] + [row(f"i{21 + i:03}", score=-8.0, whole=[-1.0, 0.1 * i], cap=15) for i in range(8)]
    got = [i for i, _ in chosen(spark, rows)["g"]]
    assert len(got) == 15 and "i020" in got and sum(i >= "i021" for i in got) == 2
    assert [i for i, _ in chosen(spark, rows[::-1])["g"]] == got


def test_burst_signals_are_local(spark):
    rows = [row(f"{i:02}", score=3 - i / 100, scene=0, burst=i // 6, moment=i // 6, whole=[1.0, 0.0], cap=15) for i in range(30)]
    for i in range(12, 18):
        rows[i]["expression"] = 0.01
    rows[17].update(expression=0.05, score=-2.0)
    assert ("17", "burst alternative: expression") in chosen(spark, rows)["g"]


def test_caps_and_cases(spark):
    wide = lambda cap: [row(f"{i:02}", scene=i % 10, whole=[1.0, float(i)], cap=cap) for i in range(50)]
    for cap, strict, want in [(4, False, 10), (18, False, 18), (4, True, 4), (99, False, 50)]:
        assert len({i for i, _ in chosen(spark, wide(cap), strict=strict)["g"]}) == want
    odd = [row("a"), row("a"), row(None), row("b", score=None), row("c", score=float("nan")), row("d", score=float("inf"))]
    assert chosen(spark, odd) == {"g": [("a", "all fit")]}
    assert chosen(spark, odd[:0]) == {}
    none = [row(f"{i:02}", score=float(i), cap=5) for i in range(9)]
    assert [w for _, w in chosen(spark, none)["g"]][-2:] == ["exploration"] * 2  # rows without a vector are never new


def test_a_walk_in_batches_equals_comparing_all_rows_with_each_pick(monkeypatch):
    """Half of a group is chosen, as shortlists do. Besides its batches, a walk makes some million of the two million pairs of rows and picks."""
    n, cap = 2000, 1000
    g = np.random.default_rng(5)
    x = g.standard_normal((n, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    quality = np.sort(1 / (1 + np.exp(-2 * g.standard_normal(n))))[::-1]
    zero = np.zeros(n)
    q = {"item": np.arange(n), "scene": g.integers(0, 5, n), "block": np.full(n, -1), "place_of": g.integers(0, 30, n), "quality": quality, "apart": g.random(n), "uncertainty": zero}
    pairs = 0
    plain_nearest = preselection.nearest

    def counted(views, rows, picks):
        nonlocal pairs
        pairs += len(rows) * len(picks)
        return plain_nearest(views, rows, picks)

    monkeypatch.setattr(preselection, "nearest", counted)
    no = float("-inf")
    w = preselection.Walk(q, {"n": n, "n_scenes": 5, "champions": {}}, [(x, np.ones(n, bool))], {"coverage": no, "explore": no, "pose": {}})
    assert preselection.walk(w, [], cap, 0.5, 2, False, False)
    got = [i for i, _, _ in w.out]
    want = sorted(int(np.flatnonzero(q["scene"] == s)[0]) for s in range(5))
    like = x @ x.T
    while len(want) < cap:
        closest = np.clip(like[:, want].max(1), -1, 1)
        fresh = ~np.isin(q["place_of"], q["place_of"][want])
        worth = preselection.coverage_worth(quality, closest, fresh) if len(want) < cap - 2 else preselection.explore_worth(closest, q["apart"], zero)
        worth[want] = no
        want.append(int(np.argmax(worth)))
    assert got == want
    assert pairs < n * cap * 2 / 3


def test_vectors_may_come_by_themselves(spark):
    rows = frame(spark, random_rows(7, 90, 20)).drop("subject", "context").withColumn("look", F.xxhash64("whole"))
    looks = rows.select("item", "look", "whole")
    told = lambda d: sorted(map(tuple, d.collect()))
    assert told(diverse_preselection(rows.drop("whole"), ["grp"], "cap", looks=looks.unionByName(looks))) == told(diverse_preselection(rows.drop("look"), ["grp"], "cap"))
