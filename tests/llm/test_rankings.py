"""Pairwise strengths, survivors, top N and leximin: brute force and the defined cases."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanframe.llm import leximin, pairwise, survivor, topn
from gleanframe.operators import graph

NAN = float("nan")
T0 = datetime(2021, 3, 1)


def clash(df):
    """Further columns with names the operators use inside."""
    for c in ("g0", "grp", "item", "part", "r", "low", "rank", "trust", "x", "n", "e0", "b0", "a", "b", "vote"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(1))
    return df


# ---- 1 --------------------------------------------------------------------------------------------------------------------------------


def votes(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, s string, w string, l string")


def rank(df, **how):
    return {(r["s"], r["item"]): r for r in pairwise.rank_comparisons(df, "s", "w", "l", "seq", **how).collect()}


def test_strengths_recover_the_order(spark):
    r = random.Random(2)
    true = {f"i{i:02}": (i - 10) / 4 for i in range(20)}
    rows = []
    for _ in range(3000):
        a, b = r.sample(sorted(true), 2)
        rows.append(("s", a, b) if r.random() < 1 / (1 + np.exp(true[b] - true[a])) else ("s", b, a))
    got = rank(votes(spark, rows))
    order = [i for (_, i), x in sorted(got.items(), key=lambda kv: kv[1]["place"])]
    assert np.corrcoef([true[i] for i in order], range(20))[0, 1] < -0.97
    inside = [abs(got[("s", i)]["strength"] - t - np.mean([x["strength"] for x in got.values()]) + np.mean(list(true.values()))) < 3 * got[("s", i)]["std_error"] for i, t in true.items()]
    assert np.mean(inside) > 0.9


def test_few_easy_wins_do_not_lead(spark):
    rows = [("s", "star", f"m{i % 4}") for i in range(20)] + [("s", f"m{i % 4}", "star") for i in range(4)] + [("s", f"m{i}", "weak") for i in range(4)] * 3 + [("s", "lucky", "weak")] * 2
    got = rank(votes(spark, rows))
    assert got[("s", "star")]["place"] == 1 and got[("s", "lucky")]["strength"] < got[("s", "star")]["strength"]


@pytest.mark.parametrize("ends", [60])
def test_groups_of_many_blocks_end_at_the_same_strengths(spark, ends):
    r = random.Random(3)
    rows = [("big", f"i{r.randrange(12)}", f"i{r.randrange(12)}") for _ in range(150)] + [("big", "x", "y"), ("small", "p", "q")]
    a, b = rank(votes(spark, rows)), rank(votes(spark, rows), block_ends=ends)
    assert a.keys() == b.keys()
    for k in a:
        assert a[k]["strength"] == pytest.approx(b[k]["strength"], abs=2e-6) and a[k]["std_error"] == pytest.approx(b[k]["std_error"], abs=2e-6)
        assert a[k]["place"] == b[k]["place"]
        assert (a[k]["component"], a[k]["components"]) == (b[k]["component"], b[k]["components"])
    assert a[("big", "x")]["components"] == 2 and a[("big", "y")]["component"] == "x"
    head = rank(votes(spark, rows), block_ends=ends, head=3)
    assert {k: x["place"] for k, x in head.items()} == {k: x["place"] for k, x in a.items() if x["place"] <= 3}


def test_the_fit_is_the_maximum_of_its_likelihood(spark):
    """No strength can be changed to raise the penalised likelihood, also far from the middle, and a fit that cannot end is an error."""
    r = random.Random(8)
    rows = [("s", f"i{a}", f"i{b}") if r.random() < 0.9 else ("s", f"i{b}", f"i{a}") for a in range(30) for b in range(a + 1, min(a + 4, 30)) for _ in range(6)]
    got = {i: x["strength"] for (_, i), x in rank(votes(spark, rows), prior=0.1).items()}

    def slope(i):
        s, g = np.exp(got[i]), 0.1 - 0.2 * np.exp(got[i]) / (np.exp(got[i]) + 1)
        for _, w, lo in rows:
            if i in (w, lo):
                o = np.exp(got[lo if i == w else w])
                g += (i == w) - s / (s + o)
        return g

    assert max(abs(slope(i)) for i in got) < 1e-5
    with pytest.raises(RuntimeError):
        pairwise.stand_still(lambda x: x + 1, np.zeros(1), 1e-7, 5)


def test_votes_that_count_for_nothing(spark):
    rows = [("s", "a", "b"), ("s", None, "b"), ("s", "a", None), (None, "a", "b"), ("s", "c", "c")]
    df = votes(spark, rows)
    got = rank(clash(df.union(df)))
    assert set(got) == {("s", "a"), ("s", "b")} and got[("s", "a")]["wins"] == 1
    tied = rank(votes(spark, [("s", "b", "a"), ("s", "a", "b")]))
    assert [tied[("s", i)]["place"] for i in "ab"] == [1, 2]
    assert rank(votes(spark, [])) == {}
    long = "x" * 50_000
    assert ("s", long) in rank(votes(spark, [("s", long, ""), ("s", "", "b")]))


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (200, 200)], "a int, b int").union(spark.createDataFrame([(None, 1)], "a int, b int"))
    got = {r["node"]: r["component"] for r in graph.components(e).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100 and got[200] == 200
    assert graph.components(e.limit(0)).count() == 0


# ---- 2 --------------------------------------------------------------------------------------------------------------------------------

REC = "no long, id string, shoot string, burst int, score double, focus double, at timestamp"


def test_survivors_equal_a_plain_walk(spark):
    r = random.Random(5)
    rows = [(i, f"p{r.randrange(60)}", "s", r.choice([-1, None, 1, 2, 3, 4]), r.choice([None, NAN, 0.5, r.random()]), r.choice([None, NAN, 0.1, 0.2]), r.choice([None, T0 + timedelta(hours=r.randrange(9))])) for i in range(400)]
    df = spark.createDataFrame(rows + rows[:80], REC)
    one = survivor.fuse(clash(df), ["shoot", "id"], {"burst": ["burst"], "score": ["score"], "focus": ["focus"]}, "at", ["no"], {"burst": -1})
    got = {(x["shoot"], x["burst"], x["id"]) for x in survivor.survivors(one, ["shoot", "burst"], "id", ["score", "focus"]).collect()}
    best: dict = defaultdict(dict)
    for no, i, _, *vals, at in sorted(rows, key=lambda x: (x[6] or datetime.min, x[0])):
        for f, v in zip(("burst", "score", "focus"), vals):
            if v is not None and v == v and not (f == "burst" and v == -1):
                best[i][f] = v
    groups: dict = defaultdict(list)
    for i, b in best.items():
        if "burst" in b:
            groups[b["burst"]].append((-b.get("score", -1e9), -b.get("focus", -1e9), i))
    assert got == {("s", b, min(g)[2]) for b, g in groups.items() if len(g) > 1}


def test_bundles_are_taken_whole(spark):
    df = spark.createDataFrame([("e", "Kiel", "24103", 1), ("e", "Bonn", None, 9), ("e", None, None, 10)], "e string, city string, zip string, at int")
    r = survivor.fuse(df, ["e"], {"place": ["city", "zip"]}, "at").first()
    assert (r["city"], r["zip"]) == ("Kiel", "24103")  # the most complete first, then the most recent


@pytest.mark.parametrize("width", [1, 2, 32])
def test_branching_respects_dependencies(spark, width):
    rows = [(f"x{i}", "24103", "Kiel", i) for i in range(5)] + [(f"y{i}", "53111", "Bonn", i) for i in range(5)]
    # the best zip and the best city of e contradict each other; e2 is fine; e3 has no consistent pair at all
    rows += [("e", "24103", None, 9), ("e", None, "Bonn", 8), ("e", "53111", None, 4), ("e", None, "Kiel", 2), ("e2", "24103", "Kiel", 1), ("e3", "24103", None, 5), ("e3", None, "Bonn", 4)]
    df = clash(spark.createDataFrame(rows, "e string, zip string, city string, at int"))
    got = {r["e"]: (r["zip"], r["city"]) for r in survivor.fuse(df, ["e"], {"zip": ["zip"], "city": ["city"]}, "at", dependencies=[("zip", "city")], width=width).collect()}
    assert got["e2"] == ("24103", "Kiel") and got["x1"] == ("24103", "Kiel")
    assert got["e"] == ("53111", "Bonn")  # 4 + 8 in trust beats 9 + 2
    assert got["e3"] == ("24103", None)
    assert len(got) == 13


def test_survivor_empty_null_and_ties(spark):
    df = spark.createDataFrame([], REC)
    assert survivor.fuse(df, ["id"], {"s": ["score"]}, "at").count() == 0
    rows = spark.createDataFrame([("s", 1, "b", 1.0), ("s", 1, "a", 1.0), ("s", 1, "a", 1.0), ("s", 2, "z", 1.0), ("s", None, "q", 1.0), (None, 1, "q", 9.0), ("s", 1, None, 9.0)], "shoot string, burst int, id string, score double")
    assert [tuple(r) for r in survivor.survivors(rows, ["shoot", "burst"], "id", ["score"]).collect()] == [("s", 1, "a")]


# ---- 3 --------------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n, least", [(1, 1000), (3, 0), (7, 50)])
def test_top_n_equals_sorting(spark, n, least):
    r = random.Random(n)
    rows = [(r.choice(["hot", "hot", "hot", "a", "b", None]), r.choice([f"i{r.randrange(80)}", None]), r.choice([None, NAN, float("inf"), 1.0, 1.0, r.randrange(20) / 2])) for _ in range(1500)]
    df = clash(spark.createDataFrame(rows, "g string, id string, s double")).repartition(7)
    got = {(x["g"], x["id"], x["s"], x["rank"]) for x in topn.top_n(df, ["g"], "id", "s", n, least_rows=least).collect()}
    best: dict = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and s == s:
            best[g, i] = max(best.get((g, i), -1e300), s)
    want = set()
    for g in {k[0] for k in best}:
        for k, (s, i) in enumerate(sorted((-s, i) for (h, i), s in best.items() if h == g)[:n]):
            want.add((g, i, -s, k + 1))
    assert got == want


def test_one_item_cannot_fill_the_bound(spark):
    rows = [("g", "x", 10.0), ("g", "x", 9.0), ("g", "x", 8.0), ("g", "y", 7.0), ("g", "z", 6.0)]
    got = topn.top_n(spark.createDataFrame(rows, "g string, id string, s double").coalesce(1), ["g"], "id", "s", 3, least_rows=0).collect()
    assert sorted(r["id"] for r in got) == ["x", "y", "z"]


def test_top_n_bound_prunes_before_the_shuffle(spark):
    """With Spark's own broadcasts off, as at size, no exchange takes the rows of a large group: bounds come first."""
    src = spark.range(0, 40_000, 1, 8).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 900)).alias("g"), F.col("id").cast("string").alias("id"), F.rand(1).alias("s"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = topn.top_n(src, ["g"], "id", "s", 3)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "WindowGroupLimit" in plan and "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
    assert out.where("g = 'hot'").count() == 3 and topn.top_n(src.limit(0), ["g"], "id", "s", 3).count() == 0
    with pytest.raises(ValueError):
        topn.top_n(src, ["g"], "id", "s", 0)


# ---- 6 --------------------------------------------------------------------------------------------------------------------------------


def lex(rows, n_scores):
    best: dict = {}
    for g, i, *s in rows:
        if g is None or i is None:
            continue
        old = best.setdefault((g, i), [None] * n_scores)
        best[g, i] = [b if a is None or a != a else a if b is None else max(a, b) for a, b in zip(s, old)]
    out = []
    for g in {k[0] for k in best}:
        items = {i: v for (h, i), v in best.items() if h == g}
        vec = {}
        for i, v in items.items():
            p = []
            for k, x in enumerate(v):
                known = [w[k] for w in items.values() if w[k] is not None]
                p.append(0.0 if x is None else (sum(y < x for y in known) + sum(y == x for y in known) / 2) / len(known))
            vec[i] = sorted(round(x, 9) for x in p)
        out += [(g, i, k + 1) for k, i in enumerate(sorted(vec, key=lambda i: ([-x for x in vec[i]], i)))]
    return sorted(out)


@pytest.mark.parametrize("split", [20, 200_000])
def test_leximin_equals_brute_force(spark, split):
    r = random.Random(9)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([i, i, None]), r.choice([None, NAN, 0.0, 0.0, r.random() * 1e6]), r.choice([1.0, 2.0, r.random()]), r.choice([None, r.random(), 1e300])) for i in range(250)]
    df = clash(spark.createDataFrame(rows + rows[:40], "s string, id int, p double, q double, t double"))
    got = sorted((x["s"], x["id"], x["place"]) for x in leximin.leximin_rank(df, "s", "id", ["p", "q", "t"], split_rows=split).collect())
    assert got == lex(rows, 3)
    head = sorted((x["s"], x["id"], x["place"]) for x in leximin.leximin_rank(df, "s", "id", ["p", "q", "t"], head=4, split_rows=split).collect())
    assert head == [x for x in lex(rows, 3) if x[2] <= 4]


def test_no_range_or_extreme_value_carries_an_item(spark):
    rows = [("s", 1, 0.5, 500.0), ("s", 2, 0.6, 600.0), ("s", 3, 1e12, 1.0), ("s", 4, None, 1e9), ("s", 5, 0.1, 100.0)]
    df = spark.createDataFrame(rows, "s string, id int, p double, q double")
    for scaled in (df, df.withColumn("q", F.log("q") * 1e-6)):
        got = [x["id"] for x in leximin.leximin_rank(scaled, "s", "id", ["p", "q"]).orderBy("place").collect()]
        assert got[0] == 2 and got.index(3) > 1 and got[-1] == 4
    assert leximin.leximin_rank(df.limit(0), "s", "id", ["p", "q"]).count() == 0
