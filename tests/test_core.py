"""Expressions, sequences, scores, selections, decisions and evaluation on small hand-made cases."""

from __future__ import annotations

import json
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleanframe.functions import scalars as sc
from gleanframe.functions import texts, vectors
from gleanframe.operators import decisions, duplicates, evaluation, judging, reporting, scoring, selection, sequence, similarity
from gleanframe.operators.duplicates import Rule

T0 = datetime(2021, 3, 1)


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def lit(x):
    return F.lit(x)


# ---- vectors and scalars --------------------------------------------------------------------------------------------------------------


def test_vectors(spark):
    a = F.array(lit(3.0), lit(4.0))
    r = one(spark, n=vectors.norm(a), u=vectors.normalize(a), d=vectors.dot(a, F.array(lit(1.0))), c=vectors.cosine(a, a), z=vectors.normalize(F.array(lit(0.0))))
    assert (r["n"], r["u"], r["d"], r["z"]) == (5.0, [0.6, 0.8], None, None) and abs(r["c"] - 1) < 1e-12
    bad = [F.array(lit(0.0), lit(0.0)), F.array(lit(float("nan")), lit(1.0)), F.array(lit(1.0)), lit(None).cast("array<double>")]
    assert all(one(spark, v=vectors.usable(b, 2))["v"] is None for b in bad)
    df = spark.createDataFrame([("x", [1.0, 0.0]), ("x", [0.0, 1.0]), ("y", None)], "k string, v array<float>")
    got = vectors.mean_vector(df, ["k"], "v", 2).collect()
    assert len(got) == 1 and all(abs(x - math.sqrt(0.5)) < 1e-6 for x in got[0]["mean"])


@pytest.mark.parametrize("x, y", [(a, b) for a in (1 / 3, 2 / 3) for b in (1 / 3, 2 / 3)])
def test_thirds_are_met_at_crossings(spark, x, y):
    p = sc.placement(*[lit(v) for v in (x - 0.1, y - 0.1, x + 0.1, y + 0.1)])
    assert abs(one(spark, t=p["thirds"])["t"] - 1) < 1e-9


def test_placement_of_bad_boxes_is_null(spark):
    for box in [(0.5, 0.5, 0.4, 0.6), (-0.1, 0, 0.5, 0.5), (0, 0, 1.2, 1), (None, 0.0, 1.0, 1.0)]:
        p = sc.placement(*[lit(v).cast("double") for v in box])
        assert all(v is None for v in one(spark, **p))


def test_subject_budget_benefit(spark):
    r = one(spark, none=sc.subject_term(lit(0.0), lit(False)), most=sc.subject_term(lit(0.9), lit(False)), cut=sc.subject_term(lit(0.02), lit(True)),
            b6=sc.pick_budget(lit(6)), b80=sc.pick_budget(lit(80)), b454=sc.pick_budget(lit(454)), e=sc.edit_benefit(lit(0.05), lit(0.0), lit(100.0)), cap=sc.shortlist_cap(lit(97), lit(7)))
    assert r["none"] == 0 and abs(r["most"] - 0.6) < 1e-9 and r["cut"] < 0
    assert (r["b6"], r["b80"], r["b454"], r["e"], r["cap"]) == (5, 7, 15, 45, 49)


def test_boxes(spark):
    df = spark.sql("select array(named_struct('x1',0.1D,'y1',0.1D,'x2',0.2D,'y2',0.2D), named_struct('x1',0D,'y1',0D,'x2',0.5D,'y2',0.5D), named_struct('x1',0.1D,'y1',0.1D,'x2',0.2D,'y2',0.2D), named_struct('x1',0.9D,'y1',0D,'x2',0.1D,'y2',1D)) b")
    r = df.select(sc.best_boxes(F.col("b")).alias("b")).select("b", sc.surrounding_box(F.col("b")).alias("s")).first()
    assert [x["x2"] for x in r["b"]] == [0.5, 0.2] and (r["s"]["x1"], r["s"]["x2"]) == (0.0, 0.625)


@pytest.mark.parametrize("angle", [0.0, 3.0, 30.0, 45.0, 91.0, 200.0, 359.0])
def test_crop_has_no_empty_corner(spark, angle):
    w, h = 1200, 800
    c = one(spark, **sc.inscribed_crop(lit(float(w)), lit(float(h)), lit(angle)))
    a = math.radians(angle)
    if round(angle / 90) % 2:
        assert c["crop_width"] <= c["crop_height"]
    for sx in (-1, 1):
        for sy in (-1, 1):
            x, y = sx * c["crop_width"] / 2, sy * c["crop_height"] / 2
            assert abs(x * math.cos(a) - y * math.sin(a)) <= w / 2 + 1e-6 and abs(x * math.sin(a) + y * math.cos(a)) <= h / 2 + 1e-6


def test_texts(spark):
    r = one(spark, s=texts.stem(lit("a/b.c.JPG")), e=texts.suffix(lit("a/b.c.JPG")), dot=texts.suffix(lit("a/.hidden")), p=texts.parent(lit("a/b/c.d")), f=texts.folded(lit("  A \n b ")), x=texts.xml_escaped(lit('<a & "b">')), ok=texts.relative_ok(lit("a/../b")))
    assert (r["s"], r["e"], r["dot"], r["p"], r["f"], r["x"], r["ok"]) == ("b.c", ".jpg", "", "a/b", "a b", "&lt;a &amp; &quot;b&quot;&gt;", False)


@pytest.mark.parametrize("reply, want", [
    ('{"picks": [{"photo": 2}, {"photo": 1}, {"photo": 2}, {"photo": 9}, {"photo": "x"}]}', ["b", "a"]), ('Sure! {"picks": [1, 3]} bye', ["a", "c"]), ("no json", None), ('{"other": 1}', None), ('{"picks": []}', []),
])
def test_ranked_picks(spark, reply, want):
    assert one(spark, p=texts.ranked_picks(lit(reply), F.array(*map(lit, "abc"))))["p"] == want


def test_named_subjects(spark):
    reply = json.dumps({"subjects": [{"photo": 1, "subject": "Red  Fox"}, {"photo": 1, "subject": "Owl"}, {"photo": 7, "subject": "x"}, {"photo": 2, "subject": " "}]})
    assert one(spark, p=texts.named_subjects(lit(reply), F.array(*map(lit, "ab"))))["p"] == {"a": "owl"}


# ---- sequences -----------------------------------------------------------------------------------------------------------------------


def test_fold_cases():
    x, y = [1.0, 0.0], [0.0, 1.0]
    assert sequence.fold_scenes([0, 10, 1000], [x, x, x], 120, 0.8) == [0, 0, 1]
    assert sequence.fold_scenes([0, 1, 2], [x, [1, 0.05], y], 120, 0.8) == [0, 0, 1]
    assert sequence.fold_scenes([None, None], [x, x], 1, 0.8) == [0, 0]
    assert sequence.fold_moments(range(5), [0] * 5, [x] * 5, [x, x, y, y, x], 8, 0.92)[0] == [0, 0, 1, 1, 2]
    assert sequence.fold_moments([0, 1, 20, 21, None, None], [0, 0, 0, 1, 1, 1], [x] * 6, [None] * 6, 8, 0.92)[0] == [0, 0, 1, 2, 2, 2]
    drift = [[math.cos(a), math.sin(a)] for a in np.linspace(0, 1, 15)]
    assert max(sequence.fold_moments(range(15), [0] * 15, drift, [None] * 15, 8, 0.92)[0]) > 0
    assert sequence.fold_bursts([0, 1, 5, 6, 7, 8], [0, 0, 0, 0, 1, 1], [x, x, x, y, y, y], 3, 12, 0.75) == [0, 0, 1, 2, 3, 3]
    assert sequence.fold_bursts([0, 3, 6, 9, 12], [0] * 5, [x] * 5, 3, 12, 0.75) == [0, 0, 0, 0, 1]
    assert sequence.fold_bursts([None, 10, float("nan"), 11, 9], [0] * 5, [x] * 5, 3, 12, 0.75) == [-1, 0, -1, 1, 2]


def test_scenes_by_segment_equal_the_whole_fold(spark):
    r = random.Random(1)
    rows, t = [], 0
    for i in range(300):
        t += r.choice([1, 5, 60, 120, 121, 500])
        v = [r.gauss(0, 1) for _ in range(3)] if r.random() < 0.9 else None
        rows.append((i, "k", None if i > 290 else T0 + timedelta(seconds=t), v))
    df = spark.createDataFrame(rows, "id int, k string, t timestamp, v array<double>").repartition(4)
    got = dict((x["id"], x["scene_id"]) for x in sequence.cluster_scenes(df, "k", "t", "v", ["id"], 120, 0.3).collect())
    want = sequence.fold_scenes([None if x[2] is None else (x[2] - T0).total_seconds() for x in rows], [x[3] for x in rows], 120, 0.3)
    assert [got[i] for i in range(300)] == want


# ---- scores --------------------------------------------------------------------------------------------------------------------------


def test_scores_of_a_group_ignore_other_groups(spark):
    ddl = "day string, label string, id int, aesthetic double, sharpness double, subject_sharpness double, clip_high double, clip_low double, subject double, edge boolean, composition_bonus double"
    a = [("d", "x", i, 4.0 + i, 10.0 * i, None if i % 2 else 5.0 * i, 0.01 * i, 0.0, 0.1, False, None) for i in range(6)]
    b = [("e", "x", 100 + i, 1.0, 2.0, None, 0.0, 0.0, 0.0, None, 0.1) for i in range(3)]
    get = lambda rows: {r["id"]: r["score"] for r in scoring.score(spark.createDataFrame(rows, ddl), ["day", "label"]).collect() if r["id"] < 100}
    assert get(a) == pytest.approx(get(a + b))


def test_mid_rank_and_quality(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 3.0), ("b", 7.0)], "k string, x double")
    got = sorted((r["k"], r["x"], r["mid_rank"]) for r in scoring.mid_rank(df, ["k"], "x").collect())
    assert got == [("a", 1.0, -0.5), ("a", 1.0, -0.5), ("a", 3.0, 1.0), ("b", 7.0, 0.0)]
    q = {r["x"]: r["quality"] for r in scoring.robust_quality(df.where("k = 'a'"), ["k"], "x").collect()}
    assert q[1.0] == 0.5 and 0.5 < q[3.0] < 1


# ---- selection -----------------------------------------------------------------------------------------------------------------------

unit = lambda *x: (np.array(x) / np.linalg.norm(x)).tolist()


def test_greedy_with_budgets(spark):
    rows = [("a1", 0.9, "zebra", unit(1, 0, 0)), ("a2", 0.8, "zebra", unit(1, 0.01, 0)), ("a3", 0.7, "zebra", unit(0, 1, 0)), ("b1", 0.5, "gull", unit(0, 0, 1)), ("b2", 0.4, "cormorant", unit(0, 0.01, 1)), ("c1", -1.2, "shark", unit(1, 1, 1)), ("n", float("nan"), "shark", unit(1, 2, 1)), ("m", None, "shark", None)]
    df = spark.createDataFrame([("d", *r) for r in rows], "day string, id string, score double, bucket string, v array<double>")
    budgets = spark.createDataFrame([("d", "zebra", 2), ("d", "gull", 1), ("d", "cormorant", 1), ("d", "shark", 1)], "day string, bucket string, budget int")
    got = selection.greedy_select(df.withColumnRenamed("v", "whole"), ["day"], "id", "bucket", "score", budgets, Rule(0.95), -0.5).orderBy("place").collect()
    assert [r["id"] for r in got] == ["a1", "a3", "b1"]


@pytest.mark.parametrize("window", [3, 10, 1000])
def test_greedy_rounds_equal_one_walk(spark, window):
    r = random.Random(window)
    rows = [("d", f"i{i:03}", r.choice([0.1, 0.5, r.random()]), r.choice("xyz"), [r.gauss(0, 1) for _ in range(3)] if r.random() < 0.9 else None, r.choice(["", "h1", "h2", f"u{i}"])) for i in range(120)]
    df = spark.createDataFrame(rows, "day string, id string, score double, bucket string, v array<double>, digest string")
    budget = {"x": 5, "y": 9, "z": 2}
    budgets = spark.createDataFrame([("d", b, n) for b, n in budget.items()], "day string, bucket string, budget int")
    picks: list = []
    for row in sorted(rows, key=lambda x: (-x[2], x[1])):
        same = lambda p: (p[5] and p[5] == row[5]) or (p[4] and row[4] and np.dot(unit(*p[4]), unit(*row[4])) >= 0.8)
        if sum(p[3] == row[3] for p in picks) < budget[row[3]] and not any(same(p) for p in picks):
            picks.append(row)
    got = selection.greedy_select(df.withColumnRenamed("v", "whole"), ["day"], "id", "bucket", "score", budgets, Rule(0.8), window=window).orderBy("place").collect()
    assert [x["id"] for x in got] == [p[1] for p in picks]


def test_scene_first_chunks_quotas(spark):
    df = spark.createDataFrame([("g", "s0a", 0, 0.9), ("g", "s0b", 0, 0.8), ("g", "s0c", 0, 0.85), ("g", "s1a", 1, 0.5), ("g", "s2a", 2, 0.4)], "g string, id string, scene int, score double")
    take = lambda cap: [r["id"] for r in selection.scene_first(df, ["g"], "scene", "score", "id", cap).orderBy("place").collect()]
    assert take(4) == ["s0a", "s1a", "s2a", "s0c"] and take(2) == ["s0a", "s1a"]
    many = spark.range(50).withColumn("g", F.lit(1))
    sizes = [r["count"] for r in selection.balanced_chunks(many, ["g"], [F.col("id")], 24).groupBy("chunk").count().collect()]
    assert sorted(sizes) == [16, 17, 17]
    q = spark.createDataFrame([("a", 100), ("b", 4), ("c", 1)], "l string, n int")
    assert {r["l"]: r["quota"] for r in selection.sqrt_quotas(q, "l", "n", 13).collect()} == {"a": 10, "b": 2, "c": 1}


def test_tournament_is_the_top(spark):
    df = spark.range(500).select(F.lit("g").alias("g"), F.col("id").cast("string").alias("id"), F.pmod(F.xxhash64("id"), F.lit(90)).alias("s"))
    want = [(r["id"]) for r in df.orderBy(F.desc("s"), "id").limit(5).collect()]
    assert [r["id"] for r in selection.tournament(df, ["g"], "id", "s", 5).orderBy("place").collect()] == want


def test_burst_chunks_of_many_batches():
    """The fullest batch a block fits is found without looking at all batches; this took some ten seconds before."""
    import time

    r = random.Random(1)
    blocks = [int(r.expovariate(1) * 15_000) for _ in range(60_000)]
    start = time.process_time()
    got = selection.burst_chunks(list(range(60_000)), blocks)
    assert time.process_time() - start < 3
    assert sorted(i for b in got for i in b) == list(range(60_000)) and max(map(len, got)) <= 24 and len(got) == 2500


def test_burst_chunks_keep_blocks():
    got = selection.burst_chunks(list(range(30)), [0] * 10 + [1] * 10 + [2] * 10, 16)
    assert sorted(x for b in got for x in b) == list(range(30)) and all(len(b) <= 16 for b in got) and len(got) == 2
    # what fits nowhere fills the emptiest batch first
    assert [len(b) for b in selection.burst_chunks(list(range(16)), [0] * 6 + [1] * 5 + [2] * 5, 8)] == [8, 8]
    assert selection.burst_chunks(list(range(16)), [0] * 6 + [1] * 5 + [2] * 5, 8)[1] == [6, 7, 8, 9, 10, 11, 12, 13]


def test_twins_classify_reference_components(spark):
    df = spark.createDataFrame([("a", "h", 1.0), ("b", "h", 2.0), ("c", "", 1.0), ("d", None, 1.0), ("e", "h", 2.0)], "id string, digest string, score double")
    assert {r["id"]: (r["keeper"], r["twins"]) for r in similarity.exact_twins(df, "id", "digest", "score").collect()} == {"a": ("b", 3), "b": ("b", 3), "e": ("b", 3), "c": ("c", 1), "d": ("d", 1)}
    labels = spark.createDataFrame([(0, "cat", False, [1.0, 0.0]), (1, "man", True, [0.0, 1.0]), (2, "dog", False, [1.0, 0.0])], "idx int, label string, is_people boolean, tv array<double>")
    rows = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0]), ("z", None)], "id string, v array<double>")
    got = {r["id"]: (r["label"], round(r["people_prob"], 3)) for r in similarity.classify(rows, "id", "v", labels, "tv").collect()}
    assert got == {"x": ("cat", 0.0), "y": ("man", 1.0)}
    bonus = {r["id"]: r["bonus"] for r in similarity.reference_bonus(rows, "id", "v", np.array([[1.0, 0.0]])).collect()}
    assert bonus == {"x": 0.5, "y": 0.0, "z": 0.0}
    picks = spark.createDataFrame([("d", "p", "x", [1.0, 0.0]), ("d", "q", "y", [1.0, 0.01]), ("d", "r", "y", [0.0, 1.0]), ("d", "s", "x", None)], "day string, id string, b string, v array<double>")
    comp = {r["id"]: r["component"] for r in duplicates.duplicate_components(picks.withColumnRenamed("v", "whole"), ["day"], "id", "b", Rule()).collect()}
    assert comp == {"p": "p", "q": "p", "r": "r", "s": "s"}
    r = random.Random(1)
    many = [("d", f"i{i:02}", r.choice("xyz"), [r.gauss(0, 1), r.gauss(0, 1), r.gauss(0, 1)]) for i in range(60)]
    df = spark.createDataFrame(many, "day string, id string, bucket string, whole array<double>")
    whole, cut = ({x["id"]: x["component"] for x in duplicates.duplicate_components(df, ["day"], "id", "bucket", Rule(0.97), block=b).collect()} for b in (2000, 7))
    assert whole == cut and 1 < len(set(whole.values())) < 60


def at_cosine(c):
    return [1.0, 0.0], [c, math.sqrt(1 - c * c)]


def test_duplicate_rules():
    def dup(whole, crop, pixel, reframe=0.98, scenes=(1, 1), d=("x", "y"), base=0.89, clip=None):
        vectors = {n: at_cosine(c) if c is not None else (None, None) for n, c in (("whole", whole), ("crop", crop), ("pixels", pixel), ("clip", clip))}
        v = duplicates.Views(pd.DataFrame({"digest": d, "scene": scenes, "bucket": ["b", "b"], **{n: list(x) for n, x in vectors.items()}}))
        return bool(v.duplicates([0], v, [1], Rule(base, 0.9, reframe))[0, 0])

    triples = [(0.9456, 0.9162, 0.6941), (0.9649, 0.9639, 0.1880), (0.9910, 0.9834, 0.8457)]
    for t in triples:
        assert dup(*t, 0.94) and not dup(*t, 0) and not dup(*t, 0.94, scenes=(-1, -1)) and not dup(*t, 0.94, scenes=(1, 2))
    assert [dup(*t) for t in triples] == [False, False, True]
    assert dup(0.0, None, None, d=("h", "h")) and not dup(0.0, None, None, d=("", "")) and dup(0.95, None, None) and not dup(0.95, None, 0.1)
    assert dup(None, None, None, clip=0.95) and not dup(0.1, None, None, clip=0.95)


def test_judged_rounds(spark):
    rows = [("g", i // 24, f"i{i:03}", float((i * 37) % 101), "b", 15) for i in range(60)] + [("h", 0, "x", 1.0, "b", 15)]
    df = spark.createDataFrame(rows, "g string, batch int, item string, score double, bucket string, k int")
    best = [i for _, i in sorted((-r[3], r[2]) for r in rows if r[0] == "g")[:15]]
    won = judging.judged_tournament(df, ["g"], "k").where("place IS NOT NULL AND g = 'g'").orderBy("place").collect()
    assert [r["item"] for r in won] == best
    reasons = {r["reason"] for r in judging.judged_tournament(df, ["g"], "k").where("place IS NULL").collect()}
    assert reasons == {"Not selected by judge", "Not selected in final comparison"}

    def careless(batch, k, final):  # strangers, repeats and too many
        return ["nobody", *batch["item"], *batch["item"]]

    out = judging.judged_round(df, ["g"], "k", careless, False).where("place IS NOT NULL").groupBy("g", "batch").count().collect()
    assert {(r["g"], r["batch"]): r["count"] for r in out} == {("g", 0): 15, ("g", 1): 15, ("g", 2): 12, ("h", 0): 1}

    def fails_on_h(batch, k, final):
        if batch["item"].iloc[0] == "x":
            raise OSError("no answer")
        return judging.by_score(batch, k, final)

    assert judging.judged_round(df, ["g"], "k", fails_on_h, False).where("item = 'x'").first()["reason"] == judging.FAILED
    with pytest.raises(RuntimeError):
        judging.judged_round(df, ["g"], "k", lambda b, k, f: 1 / 0, False).count()


def test_reconciled_days(spark):
    rows = [("d", "p/a", "x", 1.0, "h", [1.0, 0.0]), ("d", "p/b", "y", 2.0, "h", [1.0, 0.0]), ("d", "p/c", "x", 1.0, "", [0.99, 0.1]), ("d", "p/d", "x", 0.5, None, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "day string, id string, bucket string, score double, digest string, whole array<double>")
    keep_one = lambda batch, k, final: judging.by_score(batch, 1, final)
    got = {r["id"]: (r["kept"], r["reason"]) for r in judging.reconcile(df, ["day"], "id", "bucket", Rule(), keep_one).collect()}
    assert got == {"p/a": (False, "= identical copy of b"), "p/b": (True, ""), "p/c": (False, "Not selected in final comparison"), "p/d": (True, "")}


def test_checked_roll(spark):
    rows = [("portrait", True, "Lion", "m1", False, ""), ("ordinary", True, "lion", "m2", False, ""), ("vague", True, "lion", "m3", True, ""), ("same", True, "lion", "M1", True, "rare"), ("action", True, " lion", "hunt", True, "rare"),
            ("third", True, "lion", "m5", True, "rare"), ("bird", True, "eagle", "dive", False, ""), ("human", False, "people", "smile", False, ""), ("empty", True, "", "x", False, ""), ("blank", True, "owl", " ", False, "")]
    df = spark.createDataFrame([("r", i, *r) for i, r in enumerate(rows)], "g string, o int, id string, fits boolean, kind string, detail string, special boolean, why string")
    run = lambda limit, curate=True: judging.checked_picks(df, ["g"], "o", "id", F.col("fits"), "kind", "detail", F.col("special"), "why", limit, curate).collect()
    assert [r["id"] for r in run(9) if r["kept"]] == ["portrait", "action", "bird"] and [r["id"] for r in run(1) if r["kept"]] == ["portrait"]
    assert {r["id"]: r["reason"] for r in run(1)}["bird"] == "collection budget filled" and sum(r["kept"] for r in run(9, False)) == 7


# ---- decisions and evaluation ----------------------------------------------------------------------------------------------------------


def test_decisions(spark):
    log = spark.createDataFrame([(1, "p", "i1", "keep", "", "u"), (2, "p", "i1", "reject", "soft", "u"), (3, "q", "i2", "keep", "", "u"), (4, "q", "i3", "clear", "", "u")], "revision int, relative string, item_id string, choice string, note string, origin string")
    assert {(r["item_id"], r["choice"]) for r in decisions.decisions_at(log).collect()} == {("i1", "reject")}
    assert {(r["item_id"], r["choice"]) for r in decisions.decisions_at(log, lit(3)).collect()} == {("i1", "reject"), ("i2", "keep")}
    rows = spark.createDataFrame([("i1", "p", True), ("i9", "p", False), ("i5", "z", True)], "item_id string, relative string, auto_selected boolean")
    got = {r["item_id"]: (r["auto_selected"], r["selected"], r["status"], r["manual_reason"]) for r in decisions.overlay(rows, decisions.decisions_at(log)).collect()}
    assert got == {"i1": (True, False, "applied", "Manual reject: soft"), "i9": (False, False, "stale decision", ""), "i5": (True, True, "", "")}
    state = spark.createDataFrame([("old/a", "h1", "keep"), ("old/b", "h2", "keep"), ("here", "h3", "keep")], "relative string, digest string, choice string")
    now = spark.createDataFrame([("new/a", "h1"), ("new/b", "h2"), ("new/c", "h2"), ("here", "h3")], "relative string, digest string")
    assert [(r["old_relative"], r["new_relative"]) for r in decisions.moved(state, now).collect()] == [("old/a", "new/a")]
    up = decisions.upsert_column(spark.createDataFrame([("a", "1"), ("b", "2")], "file string, x string"), "file", "x", spark.createDataFrame([("b", "9")], "file string, x string"))
    assert {(r["file"], r["x"]) for r in up.collect()} == {("a", "1"), ("b", "9")}


def test_unknown_is_never_a_miss(spark):
    m = spark.createDataFrame([("s", "g1", True), ("s", "g1", None), ("s", "g2", False), ("s", "g3", None), ("s", "g3", False)], "shoot string, g string, v boolean")
    r = evaluation.recall_counts(evaluation.group_verdicts(m, ["shoot", "g"], "v"), ["shoot"]).first()
    assert (r["hits"], r["total"], r["unknown"], r["recall"], round(r["recall_lower"], 4), round(r["recall_upper"], 4)) == (1, 2, 1, None, 0.3333, 0.6667)
    only = evaluation.recall_counts(spark.createDataFrame([("s", False), ("s", None)], "shoot string, verdict boolean"), ["shoot"]).first()
    assert (only["recall"], only["recall_lower"], only["recall_upper"]) == (None, 0.0, 0.5)
    b = lambda c, l, u: one(spark, x=evaluation.within_budget(lit(c), lit(l).cast("int"), lit(u)))["x"]  # noqa: E731,E741
    assert [b(3, 2, 5), b(1, 2, 0), b(1, 2, 1), b(1, None, 0)] == [False, True, None, None]
    red = evaluation.redundant(spark.createDataFrame([("s", "g", True), ("s", "g", True), ("s", "h", None)], "shoot string, g string, v boolean"), ["shoot"], ["g"], "v").first()
    assert (red["excess"], red["fully_evaluated"]) == (1, 1)


def test_reporting(spark):
    r = one(spark, a=reporting.fixed(lit(0.125), 2), b=reporting.fixed(lit(12345.678), 1), n=reporting.fixed(lit(None).cast("double"), 2), x=reporting.sidecar(lit(5), F.array(lit("a&b")), lit(""), lit("Green")))
    assert (r["a"], r["b"], r["n"]) == ("0.12", "12345.7", "") and "<rdf:li>a&amp;b</rdf:li>" in r["x"] and 'Rating="5"' in r["x"]
    df = spark.createDataFrame([(1, "A.jpg"), (2, "a.JPG"), (3, "b.jpg")], "id int, name string").withColumn("d", lit("x"))
    assert [r["target"] for r in reporting.unique_names(df, ["d"], "name", [F.col("id")]).orderBy("id").collect()] == ["A.jpg", "a_2.JPG", "b.jpg"]


# ---- refinements, models, streams ------------------------------------------------------------------------------------------------------


def test_refinements(spark):
    from gleanframe.operators import refine

    states = refine.source_states(spark.createDataFrame([("a", "h"), ("b", "h"), ("c", None), ("d", "h")], "file string, sha256 string"), spark.createDataFrame([("a", "h"), ("b", "x"), ("c", "h")], "file string, digest string"))
    assert {r["file"]: r["state"] for r in states.collect()} == {"a": "available", "b": "changed", "c": "unverified", "d": "missing"}
    picks = [("s", 1, "portrait", "lion", "rest", False), ("s", 2, "same", "lion", "Rest", True), ("s", 3, "action", "Lion ", "hunt", True), ("s", 4, "third", "lion", "drink", True), ("s", 5, "vague", "owl", "", True), ("s", 6, "bird", "eagle", "dive", False), ("s", 7, "late", "hare", "run", False), ("s", 8, "none", None, "run", False)]
    df = spark.createDataFrame(picks, "s string, o int, id string, k string, d string, e boolean")
    got = {r["item"]: r["reason"] for r in refine.capped_picks(df, ["s"], "o", "id", "k", "d", F.col("e"), 2, 3).collect()}
    assert got == {"portrait": "", "same": "repeated kind", "action": "", "third": "repeated kind", "vague": "no detail", "bird": "", "late": "limit reached", "none": "no kind"}
    paths = spark.createDataFrame([("/x/a/b.jpg",), ("/x/c.jpg",), ("/y/ab.jpg",)], "p string")
    m = refine.match_suffix(paths, "p", spark.createDataFrame([("a/b.jpg",), ("b.jpg",), ("c.jpg",)], "f string"), "f")
    assert {r["p"]: (r["f"], r["matches"]) for r in m.collect()} == {"/x/a/b.jpg": (None, 2), "/x/c.jpg": ("c.jpg", 1), "/y/ab.jpg": (None, 0)}
    r = spark.createDataFrame([("g", 1, "a", 3.0, 2.0), ("g", 1, "b", 2.5, 2.0), ("g", 1, "c", 1.0, 0.5), ("g", 2, "d", 9.0, 1.0)], "g string, m int, id string, s double, f double")
    assert [x["id"] for x in refine.close_focus_candidates(r, ["g"], "m", "id", "s", "f").orderBy("place").collect()] == ["a", "b"]
    z = refine.refined_focus(spark.createDataFrame([("g", 1, "a", 0.5, 10.0), ("g", 1, "b", 0.0, 1000.0), ("g", 2, "c", 0.0, 5.0)], "g string, m int, id string, f double, d double"), ["g"], "m", "id", "f", "d")
    assert {x["id"]: x["adjustment"] for x in z.collect()} == {"a": -1.5, "b": 1.0}


def test_models_lose_only_the_bad_row(spark):
    from gleanframe.functions.models import apply_model

    def load():
        def model(b):
            if (b.x < 0).any():
                raise ValueError("negative")
            return pd.DataFrame({"y": b.x * 2})

        return model

    df = spark.createDataFrame([(i, float(i) if i != 3 else -1.0) for i in range(8)], "id int, x double").coalesce(1)
    got = {r["id"]: (r["y"], r["error"]) for r in apply_model(df, ["id"], ["x"], load, "y double", batch=4).collect()}
    assert got[3] == (None, "ValueError: negative") and all(got[i] == (2.0 * i, None) for i in range(8) if i != 3)


def test_margins(spark):
    v = F.array(lit(0.6), lit(0.8))
    m = vectors.margins(v, [("a", [1, 0], [0, 1]), ("b", [0, 1], [0, 0])])
    r = one(spark, **m, best=vectors.best_margin([v, lit(None).cast("array<double>")], [0, 1], [1, 0]))
    assert (round(r["a"], 6), round(r["b"], 6), round(r["mean_margin"], 6), round(r["best"], 6)) == (-0.2, 0.8, 0.3, 0.2)


def test_exif_tags():
    import struct

    from gleanframe.functions.exif import ISO, ORIENTATION, ORIGINAL, tags

    for e, mark in (("<", b"II"), (">", b"MM")):
        text = b"2021:03:01 10:00:00\0"
        ifd0 = struct.pack(e + "H", 2) + struct.pack(e + "HHIHH", ORIENTATION, 3, 1, 6, 0) + struct.pack(e + "HHII", 0x8769, 4, 1, 38) + struct.pack(e + "I", 0)
        sub = struct.pack(e + "H", 2) + struct.pack(e + "HHIHH", ISO, 3, 1, 800, 0) + struct.pack(e + "HHII", ORIGINAL, 2, len(text), 68) + struct.pack(e + "I", 0)
        tiff = mark + struct.pack(e + "HI", 42, 8) + ifd0 + sub
        tiff = tiff[:68] + b"\0" * (68 - len(tiff)) + text
        jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xd9"
        for data in (tiff, jpeg):
            t = tags(data)
            assert (t[ORIENTATION], t[ISO], t[ORIGINAL]) == (6, 800, "2021:03:01 10:00:00")
        for cut in range(0, len(jpeg), 3):
            tags(jpeg[:cut])
    assert tags(None) == tags(b"") == tags(b"junk" * 9) == {}


def test_stream_scenes_keep_their_centroid(spark, tmp_path):
    from gleanframe.streaming.sessions import stream_scenes

    ddl, src = "k string, t timestamp, id int, v array<double>", tmp_path / "in"
    src.mkdir()
    at = lambda s: T0 + timedelta(seconds=s)
    x, y = [1.0, 0.0], [0.0, 1.0]
    q = stream_scenes(spark.readStream.schema(ddl).parquet(str(src)), "k", "t", "id", "v").writeStream.format("memory").queryName("scenes").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for batch in ([("a", at(0), 1, x), ("a", at(10), 2, x)], [("a", at(20), 3, [1.0, 0.05]), ("a", at(30), 4, y), ("b", at(0), 9, None)], [("a", at(5), 5, x), ("a", at(400), 6, y)]):
            spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(str(src))
            q.processAllAvailable()
        got = {r["id"]: (r["scene"], r["late"]) for r in spark.table("scenes").collect()}
    finally:
        q.stop()
    assert got == {1: (0, False), 2: (0, False), 3: (0, False), 4: (1, False), 9: (0, False), 5: (1, True), 6: (2, False)}


def test_detections(spark):
    ddl = "id int, b array<struct<kind:string,confidence:double,x1:double,y1:double,x2:double,y2:double>>"
    rows = [(1, [("person", 0.9, 10.0, 10.0, 30.0, 60.0), ("bird", 0.4, 0.0, 20.0, 50.0, 80.0), ("person", 0.3, 5.0, 5.0, 95.0, 95.0)]), (2, []), (3, None)]
    got = {r["id"]: r["d"] for r in spark.createDataFrame(rows, ddl).select("id", sc.detected(F.col("b"), lit(100.0), lit(100.0)).alias("d")).collect()}
    assert (got[1]["person"], got[1]["subject"], got[1]["edge"], len(got[1]["boxes"])) == (0.1, 0.81, False, 3)
    assert (got[2]["person"], got[2]["subject"], got[2]["edge"], got[2]["box"]) == (0.0, 0.0, False, None) and got[3]["subject"] == 0.0


def test_a_run_against_what_was_declared(spark):
    declared = spark.createDataFrame([("s", "a", "a.jpg"), ("s", "b", "b.jpg")], "shoot string, id string, file string")
    report = spark.createDataFrame([("s", "a", "x"), ("s", None, "b.jpg")], "shoot string, photo_id string, file string")
    assert {(r["id"], r["file"]) for r in evaluation.match_declared(report, declared, ["shoot"]).collect()} == {("a", "x"), ("b", "b.jpg")}
    for bad in ([("s", "z", "z.jpg")], [("s", "a", "x"), ("s", None, "a.jpg")]):
        with pytest.raises(ValueError):
            evaluation.match_declared(spark.createDataFrame(bad, report.schema), declared, ["shoot"])
    run = lambda rows: spark.createDataFrame(rows, "shoot string, id string, picked boolean, digest string")
    a, b = run([("s", "a", True, "h"), ("s", "b", False, "")]), run([("s", "a", True, "h"), ("s", "b", True, "k")])
    assert tuple(evaluation.comparison(a, b, ["shoot"], "id", "picked", "digest").first()) == ("s", 0.5, False)
    for other in (run([("s", "a", True, "h")]), run([("s", "a", True, "x"), ("s", "b", True, "k")])):
        with pytest.raises(ValueError):
            evaluation.comparison(a, other, ["shoot"], "id", "picked", "digest")
    used = evaluation.usage_totals(spark.createDataFrame([("d", 5, None), ("d", None, None)], "split string, requests int, tokens int"), ["split"], ["requests", "tokens"]).first()
    assert (used["requests"], used["requests_measured"], used["tokens"], used["tokens_measured"]) == (5, 1, None, 0)
    state = spark.createDataFrame([("i", "keep", "u"), ("j", "reject", "csv import"), ("k", "reject", None)], "item_id string, choice string, origin string")
    assert {tuple(r) for r in evaluation.feedback(state).collect()} == {("i", "favourite"), ("k", "rejected")} and evaluation.feedback(state, True).count() == 3


def test_verified_and_attached(spark):
    state = spark.createDataFrame([("1", "a", "h"), ("2", "b", "h"), ("3", "c", "h")], "item_id string, relative string, digest string")
    found = spark.createDataFrame([("a", "h"), ("b", "x")], "relative string, digest string")
    assert {tuple(r) for r in decisions.verified(state, found).collect()} == {("1", "available"), ("2", "changed"), ("3", "missing")}
    rows = spark.createDataFrame([("a",), ("b",)], "path string")
    assert {tuple(r) for r in decisions.attached(rows, "path", spark.createDataFrame([("a", "a.dng")], "path string, twin string")).collect()} == {("a", "a.dng"), ("b", "b")}
