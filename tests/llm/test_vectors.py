"""Clusters and varied subsets: brute force, recall and the defined cases."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanframe.llm import clusters, kmeans, varied

D = 16


def looks(seed=0, n_looks=40, copies=(1, 2, 3, 9, 30), noise=0.05):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n_looks):
        c = rng.standard_normal(D)
        c /= np.linalg.norm(c)
        for _ in range(copies[i % len(copies)]):
            out.append((c + noise * rng.standard_normal(D) / 2) * rng.uniform(0.5, 3))
    return out


def brute(vectors, cosine):
    """Cluster and whether all alike of each row number."""
    x = np.array(vectors)
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= cosine
    part = np.arange(len(x))
    while True:
        new = np.array([part[link[i]].min() for i in range(len(x))])
        if (new == part).all():
            break
        part = new
    return {i: (int(part[i]), bool(link[np.ix_(part == part[i], part == part[i])].all())) for i in range(len(x))}


def frame(spark, vectors, ids=None):
    rows = [(i, None if v is None else [float(a) for a in v]) for i, v in zip(ids or range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, "id long, v array<float>").repartition(5)


@pytest.mark.parametrize("cell, block, cosine", [(4000, 8192, 0.9), (20, 8, 0.9), (20, 8, 0.6), (15, 5, 0.35)])
def test_clusters_equal_brute_force(spark, cell, block, cosine):
    """Also with tiny cells and blocks, and with a cosine so low that clusters chain and are not all alike."""
    v = looks()
    want = brute(np.array(v, dtype=np.float32).astype(float), cosine)
    df = frame(spark, v).withColumn("node", F.lit(1)).withColumn("cell", F.lit(2)).withColumn("vec", F.lit(3)).withColumn("size", F.lit(0))
    out = clusters.alike_clusters(df, "id", "v", D, cosine, cell_rows=cell, block_rows=block, probes=8).collect()
    got = {r["id"]: (r["cluster_id"], r["alike"]) for r in out}
    same = np.mean([got[i] == want[i] for i in want])
    assert len(out) == len(v) and same >= 0.99


def test_cluster_cases(spark):
    a = [1.0] + [0.0] * (D - 1)
    b = [0.0, 1.0] + [0.0] * (D - 2)
    rows = [(1, a), (2, [2.0, 0.0] + [0.0] * (D - 2)), (3, b), (4, None), (5, [0.0] * D), (6, [1.0] * (D - 1)), (7, [float("nan")] + a[1:]), (8, [float("inf")] + a[1:]), (None, a), (2, [2.0, 0.0] + [0.0] * (D - 2)), (9, [1e-30] + a[1:]), (10, [3e38] + a[1:])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = {r["id"]: (r["cluster_id"], r["size"], r["alike"]) for r in clusters.alike_clusters(df, "id", "v", D).collect()}
    assert got == {1: (1, 4, True), 2: (1, 4, True), 9: (1, 4, True), 10: (1, 4, True), 3: (3, 1, True)}
    assert clusters.alike_clusters(df.limit(0), "id", "v", D).count() == 0
    assert clusters.alike_clusters(df.where("id in (4, 5)"), "id", "v", D).count() == 0


def test_a_look_of_half_the_rows(spark):
    rng = np.random.default_rng(1)
    c = np.eye(D)[0]
    v = [c + 0.02 * rng.standard_normal(D) for _ in range(600)] + looks(2, 20)
    out = clusters.alike_clusters(frame(spark, v), "id", "v", D, 0.9, cell_rows=60, block_rows=50)
    big = out.where("cluster_id = 0").agg(F.count("*").alias("n"), F.min("size").alias("s"), F.min("alike").alias("a")).first()
    assert (big["n"], big["s"], big["a"]) == (600, 600, True)
    # blocks share the middles of the looks of a dense cell, so few nodes are left to meet, in stripes of a few
    again = clusters.alike_clusters(frame(spark, v), "id", "v", D, 0.9, cell_rows=60, block_rows=50, meet_nodes=5)
    assert {tuple(r) for r in again.select("id", "cluster_id", "size", "alike").collect()} == {tuple(r) for r in out.select("id", "cluster_id", "size", "alike").collect()}
    top = clusters.typical(out, "id").where("cluster_id = 0").collect()
    assert [r["place"] for r in sorted(top, key=lambda r: r["place"])] == [1, 2, 3]


@pytest.mark.parametrize("cell, block, cosine", [(4000, 8192, 0.9), (20, 8, 0.9), (20, 8, 0.6)])
def test_typical_members_are_nearest_to_the_middle_of_the_cluster(spark, cell, block, cosine):
    """Whatever nodes the members stand in: also with clusters cut by cells and blocks, and chained ones."""
    v = looks(7, 40, noise=0.15)
    df = frame(spark, v)
    out = clusters.alike_clusters(df, "id", "v", D, cosine, cell_rows=cell, block_rows=block, probes=8).persist()
    x = np.array(v, dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    members: dict[int, list[int]] = {}
    for r in out.collect():
        members.setdefault(r["cluster_id"], []).append(r["id"])
    want = {}
    for c, m in members.items():
        if len(m) >= 2:
            middle = x[m].sum(0) / np.linalg.norm(x[m].sum(0))
            want[c] = [i for _, i in sorted((round(float(np.arccos(min(1.0, x[i] @ middle))), 7), i) for i in m)][:3]
    got: dict[int, list[int]] = {}
    for r in sorted(clusters.typical(out, "id").collect(), key=lambda r: r["place"]):
        got.setdefault(r["cluster_id"], []).append(r["id"])
    assert got == want and max(map(len, members.values())) >= 30


def test_recall_of_the_probes(spark):
    """Of all truly linked pairs, the share that stands in one cluster, with many small cells."""
    v = looks(5, 300, (2, 3), 0.15)
    want = brute(np.array(v, dtype=np.float32).astype(float), 0.9)
    got = {r["id"]: r["cluster_id"] for r in clusters.alike_clusters(frame(spark, v), "id", "v", D, 0.9, cell_rows=10).collect()}
    pairs = [(i, j) for i in want for j in range(i + 1, min(i + 4, len(v))) if want[i][0] == want[j][0]]
    assert len(pairs) > 200 and np.mean([got[i] == got[j] for i, j in pairs]) >= 0.9


def test_bytes_and_hashed_features_round_trip():
    x = np.random.default_rng(0).standard_normal((7, D)).astype(np.float32)
    assert (kmeans.from_bytes(kmeans.to_bytes(x)) == x).all()
    col = pa.array([[1.0] * D, None, [0.0] * D, [1.0], [float("nan")] * D], pa.list_(pa.float32()))
    m, ok = kmeans.matrix(col, D)
    assert ok.tolist() == [True, False, False, False, False] and abs(np.linalg.norm(m[0]) - 1) < 1e-6
    h = kmeans.hashed({"scene": pa.array(["a", "a", None])}, {"scene": 0.5}, 8)
    assert (h[0] == h[1]).all() and abs(h[0]).sum() == 0.5 and not h[2].any()


def test_hashed_features_part_equal_looks(spark):
    """Two scenes of one look are two groups once the scene weighs enough, one without; typical members are the nearest to their centroid."""
    rng = np.random.default_rng(2)
    c = np.eye(D)[0]
    rows = [(i, (c + 0.05 * rng.standard_normal(D)).tolist(), "s1" if i % 2 else "s2") for i in range(80)] + [(900, None, "s1"), (None, c.tolist(), "s1"), (901, [0.0] * D, None)]
    df = spark.createDataFrame(rows, "id long, v array<float>, scene string")
    got = clusters.kmeans_groups(df, "id", "v", {"scene": 1.0}, 2, D, 16, n=100).collect()
    parts = {}
    for r in got:
        parts.setdefault(r["cluster"], set()).add(r["id"] % 2)
    assert len(got) == 80 and sorted(map(sorted, parts.values())) == [[0], [1]] and {r["size"] for r in got} == {40}
    for k in parts:
        mine = sorted((r for r in got if r["cluster"] == k), key=lambda r: r["place"])
        assert [r["angle"] for r in mine] == sorted(r["angle"] for r in mine)
    assert clusters.kmeans_groups(df.limit(0), "id", "v", {"scene": 1.0}, 2, D).count() == 0


def test_groups_are_fitted_on_all_rows(spark):
    """A look that no row of a sample of 100,000 by the hash of the item shows has a group of its own, of all its rows."""
    ids = spark.range(150_000).where("pmod(xxhash64(id), 1000000) >= 700000").limit(12)
    few = {r["id"] for r in ids.collect()}
    look = lambda at: F.array(*[F.lit(float(i == at)) for i in range(D)])
    df = spark.range(150_000).withColumn("v", F.when(F.col("id").isin(*few), look(1)).otherwise(look(0)))
    got = clusters.kmeans_groups(df.union(df.where(F.col("id") < 50)), "id", "v", {}, 2, D, 4, n=12).collect()
    assert {r["id"] for r in got if r["size"] == 12} == few and {r["size"] for r in got} == {12, 149_988}


# ---- 5 --------------------------------------------------------------------------------------------------------------------------------

DDL = "g string, id string, v array<float>, s double, bucket string, moment int"


def test_quotas_fill_like_water(spark):
    for sizes, want in [([100, 1, 1], 12), ([5, 5, 5], 7), ([3, 2, 1], 50), ([1000, 400, 90, 4], 60), ([1] * 9, 4)]:
        df = spark.createDataFrame([("g", i, n) for i, n in enumerate(sizes)], "grp string, view int, n long")
        for by in ("sqrt", "equal"):
            got = {r["view"]: r["quota"] for r in varied.quotas(df, ["grp"], "view", F.lit(want), by).collect()}
            assert sum(got.values()) == min(want, sum(sizes)) and all(0 <= got[i] <= n for i, n in enumerate(sizes))
            open_ = [i for i, n in enumerate(sizes) if got[i] < n]
            weigh = [(got[i]) / (np.sqrt(sizes[i]) if by == "sqrt" else 1) for i in open_]
            if len(open_) > 1:  # those with rows left are served in proportion, up to one slot
                assert max(weigh) - min(weigh) <= 1.01 / min(np.sqrt(sizes[i]) if by == "sqrt" else 1 for i in open_)


def test_subset_is_spread_and_whole(spark):
    rng = np.random.default_rng(3)
    cs = rng.standard_normal((6, D))
    rows = []
    for k, n in enumerate([400, 40, 20, 10, 5, 5]):  # one view holds most rows
        rows += [("g", f"{k}-{i:03}", (cs[k] + 0.03 * rng.standard_normal(D)).tolist(), float(rng.random()), f"b{i % 3}", i % 5) for i in range(n)]
    rows += [("h", f"h{i}", cs[0].tolist(), 1.0, None, None) for i in range(3)]
    df = spark.createDataFrame(rows, DDL)
    out = varied.varied_subset(df, "g", "id", "v", "s", ["bucket", "moment"], 18, dims=D, views=12).collect()
    g = [r["id"] for r in out if r["g"] == "g"]
    assert len(g) == len(set(g)) == 18 and sum(r["g"] == "h" for r in out) == 3
    per = {k: sum(x.startswith(f"{k}-") for x in g) for k in "012345"}
    assert all(per.values()) and per["0"] <= 11
    got = {r[1]: r for r in rows}
    assert len({(got[i][4], got[i][5]) for i in g if i.startswith("0-")}) >= per["0"] - 1  # buckets and moments take turns
    best = np.mean([got[i][3] for i in g])
    assert best > np.mean([r[3] for r in rows[:480]])


def test_subset_cases(spark):
    v = [1.0] * D
    rows = [("g", "a", v, 1.0, "b", 1), ("g", "a", v, 1.0, "b", 1), ("g", "b", None, None, None, None), ("g", "c", [0.0] * D, float("nan"), "", 2), (None, "d", v, 1.0, "b", 1), ("g", None, v, 1.0, "b", 1), ("z", "y", v, 1.0, "x" * 40_000, 1)]
    df = spark.createDataFrame(rows, DDL).withColumn("grp", F.lit(1)).withColumn("view", F.lit(1)).withColumn("t0", F.lit(1))
    take = lambda size: sorted((r["g"], r["id"]) for r in varied.varied_subset(df, "g", "id", "v", "s", ["bucket", "moment"], size, dims=D).collect())
    assert take(5) == [("g", "a"), ("g", "b"), ("g", "c"), ("z", "y")]
    assert len(take(1)) == 2 and take(0) == []
    sizes = spark.createDataFrame([("g", 2)], "g string, size int")
    assert [g for g, _ in take(sizes)] == ["g", "g"]
    assert varied.varied_subset(df.limit(0), "g", "id", "v", "s", ["bucket"], 3, dims=D).count() == 0
    assert varied.varied_subset(df, "g", "id", "v", "s", ["bucket"], spark.createDataFrame([("g", 99_999)], "g string, size int"), dims=D).count() == 3


@pytest.mark.parametrize("piece", [1000, 10])
def test_as_many_looks_as_there_can_be(spark, piece):
    """Near copies are taken only once every look is, also where one look holds most rows and where a size is chosen in pieces."""
    rng = np.random.default_rng(5)
    rows, look_of = [], {}
    for g, (n_looks, size) in enumerate([(30, 20), (8, 20), (60, 40)]):
        cs = rng.standard_normal((n_looks, D))
        cs /= np.linalg.norm(cs, axis=1)[:, None]
        for k in range(n_looks):
            for i in range(150 if k == 0 else 1 + k % 5):
                name = f"{g}-{k}-{i}"
                look_of[name] = (g, k)
                rows.append((f"g{g}", name, (cs[k] + 0.03 * rng.standard_normal(D)).tolist(), float(rng.random()), f"b{i % 3}", i % 4))
    sizes = spark.createDataFrame([("g0", 20), ("g1", 20), ("g2", 40)], "g string, size int")
    out = varied.varied_subset(spark.createDataFrame(rows, DDL), "g", "id", "v", "s", ["bucket", "moment"], sizes, dims=D, piece=piece).collect()
    assert len(out) == len({r["id"] for r in out}) == 80
    found = len({look_of[r["id"]] for r in out})
    assert found >= (0.95 if piece == 1000 else 0.8) * (20 + 8 + 40)


def _copies(n_copies, n_looks):
    """``n_copies`` of one look, before them in score, and other looks that share its view and direction."""
    planes = np.random.default_rng(17).standard_normal((4, D))
    rng = np.random.default_rng(11)
    side = lambda x: tuple(planes @ x > 0)
    a = np.eye(D)[0]
    found = [a]
    while len(found) <= n_looks:
        b = rng.standard_normal(D)
        b = 0.8 * a + 0.6 * (b - (b @ a) * a) / np.linalg.norm(b - (b @ a) * a)
        if side(b) == side(a) and max(b @ x for x in found) < 0.85:
            found.append(b)
    rows = [("g", f"a{i:04}", a.tolist(), 2.0 + i, "b", 1) for i in range(n_copies)]
    return rows + [("g", f"b{i}", b.tolist(), 1.0 - i / 100, "b", 1) for i, b in enumerate(found[1:])]


def test_looks_behind_any_number_of_copies(spark):
    """A look is found however many copies of another stand before it in its view."""
    rows = _copies(400, 3) + [("h", f"n{i}", None, 1.0 + i, "b", 1) for i in range(300)]
    df = spark.createDataFrame(rows, DDL)
    got = varied.varied_subset(df, "g", "id", "v", "s", ["bucket", "moment"], 3, dims=D, views=1).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["place"]) if r["g"] == "g"] == ["a0399", "b0", "b1"]
    assert {r["id"] for r in got if r["g"] == "h"} == {"n299", "n298", "n297"}


def test_a_size_is_met_also_where_all_rows_are_one_look(spark):
    df = spark.createDataFrame(_copies(200, 2), DDL)
    got = varied.varied_subset(df, "g", "id", "v", "s", ["bucket", "moment"], 160, dims=D, views=1, piece=10).collect()
    ids = [r["id"] for r in sorted(got, key=lambda r: r["place"])]
    assert ids == ["a0199", "b0", "b1"] + [f"a{i:04}" for i in range(198, 41, -1)]


@pytest.mark.parametrize("window", [3, 50])
def test_rounds_choose_as_the_walk_over_all(spark, monkeypatch, window):
    rng = np.random.default_rng(9)
    centers = kmeans.unit(rng.standard_normal((8, D)))  # two fits may differ
    monkeypatch.setattr(varied, "mini_batch", lambda points, k: centers)
    rows = []
    for g, n_looks in enumerate([3, 12, 20]):
        cs = rng.standard_normal((n_looks, D))
        for k in range(n_looks):
            rows += [(f"g{g}", f"{k}-{i}", (cs[k] + 0.25 * rng.standard_normal(D)).tolist(), float(rng.integers(5)), f"b{i % 2}", i % 3) for i in range(1 + 4 * (k % 4))]
        rows += [(f"g{g}", f"n{i}", None, 9.0, None, None) for i in range(4)]
    df = spark.createDataFrame(rows, DDL)
    sizes = spark.createDataFrame([("g0", 12), ("g1", 15), ("g2", 130)], "g string, size int")
    take = lambda **how: {tuple(r) for r in varied.varied_subset(df, "g", "id", "v", "s", ["bucket", "moment"], sizes, dims=D, views=8, **how).collect()}
    assert take(piece=1, window=window) == take()
