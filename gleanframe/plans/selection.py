"""Queries on twins, shortlists, greedy and diverse selection, quotas and tournaments over the candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanframe.functions import scalars as sc
from gleanframe.operators import duplicates, judging, preselection, scoring, selection, similarity
from gleanframe.operators.duplicates import Rule
from gleanframe.plans.registry import Registry, table
from gleanframe.session import materialize, spread

SELECTION = Registry()

_KEEP = "id, shoot, lower(trim(coalesce(bucket, 'none'))) AS bucket, CASE WHEN isnan(score) THEN NULL ELSE score END AS score, scene, burst, moment, digest, aesthetic, focus, editorial, composition, distinctiveness, uncertainty, dino"
C = f"WITH c AS (SELECT DISTINCT ON (id) {_KEEP} FROM candidates ORDER BY id), k AS (SELECT * FROM c WHERE score IS NOT NULL) "


def candidates(spark, sf, *columns):
    """Distinct candidates with clean buckets and scores; only the columns asked for are read."""
    raw = table(spark, sf, "candidates") if isinstance(sf, str) else sf
    rows = raw.select("id", *columns).dropDuplicates(["id"])
    if "bucket" in columns:
        rows = rows.withColumn("bucket", F.lower(F.trim(F.coalesce("bucket", F.lit("none")))))
    if "score" in columns:
        rows = rows.withColumn("score", scoring.clean(F.col("score")))
    return rows


def scored(spark, sf, *columns):
    return candidates(spark, sf, "shoot", "score", *columns).where("score IS NOT NULL")


def r6(c, name=None):
    return F.round(c if not isinstance(c, str) else F.col(c), 6).alias(name or c)


@SELECTION.add(
    "exact_twins",
    C + """, t AS (SELECT *, coalesce(nullif(digest, ''), chr(1) || id) AS d FROM c)
SELECT id, first_value(id) OVER (PARTITION BY shoot, d ORDER BY score DESC NULLS LAST, id) AS keeper, count(*) OVER (PARTITION BY shoot, d) AS twins FROM t""",
)
def exact_twins(spark, sf):
    return similarity.exact_twins(candidates(spark, sf, "shoot", "digest", "score"), "id", "digest", "score", ["shoot"]).select("id", "keeper", "twins")


@SELECTION.add(
    "shortlist_scene_first",
    C + """, s AS (SELECT *, row_number() OVER (PARTITION BY shoot, bucket, scene ORDER BY score DESC, id) AS i FROM k)
SELECT * FROM (SELECT id, shoot, bucket, row_number() OVER (PARTITION BY shoot, bucket ORDER BY i > 1, score DESC, id) AS place FROM s) WHERE place <= 4""",
)
def shortlist_scene_first(spark, sf):
    return selection.scene_first(scored(spark, sf, "bucket", "scene"), ["shoot", "bucket"], "scene", "score", "id", 4).select("id", "shoot", "bucket", "place")


@SELECTION.add(
    "balanced_chunks",
    C + """, n AS (SELECT *, count(*) OVER (PARTITION BY shoot) AS n, row_number() OVER (PARTITION BY shoot ORDER BY scene, score DESC, id) - 1 AS i FROM k),
b AS (SELECT *, CAST(ceil(n / 24.0) AS BIGINT) AS m FROM n)
SELECT id, shoot, CAST(CASE WHEN i < (n % m) * (n // m + 1) THEN i // (n // m + 1) ELSE n % m + (i - (n % m) * (n // m + 1)) // (n // m) END AS INT) AS chunk FROM b""",
)
def balanced_chunks(spark, sf):
    out = selection.balanced_chunks(scored(spark, sf, "scene"), ["shoot"], [F.col("scene"), F.desc("score"), F.col("id")], 24)
    return out.select("id", "shoot", "chunk")


@SELECTION.add(
    "label_quota_sqrt",
    C + """, n AS (SELECT bucket, count(*) AS n FROM k GROUP BY 1), s AS (SELECT bucket, n, unnest(range(n)) AS q FROM n),
r AS (SELECT *, row_number() OVER (ORDER BY q / sqrt(n), bucket) AS r FROM s) SELECT n.bucket, count(r.q) AS quota FROM n LEFT JOIN r ON n.bucket = r.bucket AND r.r <= 120 GROUP BY 1""",
)
def label_quota_sqrt(spark, sf):
    sizes = scored(spark, sf, "bucket").groupBy("bucket").agg(F.count("*").alias("n"))
    return selection.sqrt_quotas(sizes, "bucket", "n", 120)


@SELECTION.add(
    "work_bound",
    C + """, n AS (SELECT shoot, count(*) AS n FROM k GROUP BY 1), b AS (SELECT shoot, n, CAST(ceil(n / 24.0) AS BIGINT) AS m FROM n)
SELECT shoot, 2 * m AS requests, n + (m - 1) * 24 + least(n, 12) AS presentations FROM b""",
)
def work_bound(spark, sf):
    chunks = selection.balanced_chunks(scored(spark, sf), ["shoot"], [F.desc("score"), F.col("id")], 24)
    return selection.work_bound(chunks.groupBy("shoot", "chunk").agg(F.count("*").alias("n")), ["shoot"], "n", 12)


@SELECTION.add("tournament_topk", C + "SELECT id, shoot, row_number() OVER (PARTITION BY shoot ORDER BY score DESC, id) AS place FROM k QUALIFY place <= 10")
def tournament_topk(spark, sf):
    return selection.tournament(scored(spark, sf), ["shoot"], "id", "score", 10).select("id", "shoot", "place")


_GREEDY = "WITH RECURSIVE " + C[5:] + """, u AS (SELECT *, row_number() OVER (PARTITION BY shoot ORDER BY score DESC, id) AS rn,
  CASE WHEN len(dino) > 0 AND len(list_filter(coalesce(dino, []), lambda x: x <> 0)) > 0 THEN list_transform(coalesce(dino, []), lambda x: CAST(x AS DOUBLE)) END AS v0 FROM k),
o AS (SELECT shoot, rn, id, {bucket} AS bucket, nullif(digest, '') AS digest, list_transform(v0, lambda x: x / sqrt(list_sum(list_transform(v0, lambda y: y * y)))) AS v FROM u),
f(shoot, rn, picks) AS (SELECT shoot, 0, CAST([] AS STRUCT(id VARCHAR, bucket VARCHAR, digest VARCHAR, v DOUBLE[])[]) FROM (SELECT DISTINCT shoot FROM o)
 UNION ALL SELECT o.shoot, o.rn, CASE WHEN len(list_filter(f.picks, lambda p: p.bucket = o.bucket)) >= {budget}
   OR len(list_filter(f.picks, lambda p: coalesce(p.digest = o.digest, false) OR (len(p.v) = len(o.v) AND coalesce(list_sum(list_transform(list_zip(p.v, o.v), lambda z: z[1] * z[2])) >= {sim}, false)))) > 0
   THEN f.picks ELSE list_append(f.picks, {{'id': o.id, 'bucket': o.bucket, 'digest': o.digest, 'v': o.v}}) END
 FROM f JOIN o ON o.shoot = f.shoot AND o.rn = f.rn + 1),
l AS (SELECT shoot, arg_max(picks, rn) AS picks FROM f GROUP BY 1), p AS (SELECT shoot, unnest(picks).id AS id, unnest(picks).bucket AS bucket, generate_subscripts(picks, 1) AS place FROM l)
SELECT shoot, id, bucket, CAST(place AS INT) AS place FROM p"""  # fmt: skip


HALF = Rule(similar=0.5)


def _greedy(rows, bucket, budget):
    budgets = rows.select("shoot", bucket).distinct().withColumn("budget", F.lit(budget))
    return selection.greedy_select(rows.withColumnRenamed("dino", "whole"), ["shoot"], "id", bucket, "score", budgets, HALF)


@SELECTION.add("greedy_select", _GREEDY.format(bucket="bucket", budget=3, sim=0.5))
def greedy_select(spark, sf):
    return _greedy(scored(spark, sf, "bucket", "dino", "digest"), "bucket", 3)


@SELECTION.add("dedup_topk", _GREEDY.format(bucket="'all'", budget=8, sim=0.5))
def dedup_topk(spark, sf):
    return _greedy(scored(spark, sf, "dino", "digest").withColumn("bucket", F.lit("all")), "bucket", 8)


_VIEW = "CASE WHEN len({v}) >= {n} AND len(list_filter(coalesce({v}, []), lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 THEN list_transform(coalesce({v}[{a}:{n}], []), lambda x: CAST(x AS DOUBLE)) END"
_IP = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
_REFRAMED = "WITH RECURSIVE " + C[5:] + """, u AS (SELECT *, row_number() OVER (PARTITION BY shoot ORDER BY score DESC, id) AS rn, """ + ", ".join(
    f"{_VIEW.format(v='dino', a=a, n=n)} AS {c}0" for c, a, n in (("w", 1, 64), ("p", 1, 16), ("s", 33, 64))) + """ FROM k WHERE score >= -0.5),
o AS (SELECT shoot, rn, id, bucket, scene, nullif(digest, '') AS digest, """ + ", ".join(f"CASE WHEN list_sum(list_transform({c}0, lambda y: y * y)) > 0 THEN list_transform({c}0, lambda x: x / sqrt(list_sum(list_transform({c}0, lambda y: y * y)))) END AS {c}" for c in "wps") + """ FROM u),
f(shoot, rn, picks) AS (SELECT shoot, 0, CAST([] AS STRUCT(id VARCHAR, bucket VARCHAR, scene INT, digest VARCHAR, w DOUBLE[], p DOUBLE[], s DOUBLE[])[]) FROM (SELECT DISTINCT shoot FROM o)
 UNION ALL SELECT o.shoot, o.rn, CASE WHEN len(list_filter(f.picks, lambda q: q.bucket = o.bucket)) >= 5
   OR len(list_filter(f.picks, lambda q: coalesce(q.digest = o.digest, false)
     OR (coalesce(""" + _IP.format(a="q.w", b="o.w") + " >= 0.4, false) AND coalesce(" + _IP.format(a="q.p", b="o.p") + " >= 0.8, true) AND coalesce(" + _IP.format(a="q.s", b="o.s") + """ >= 0.4, true))
     OR (q.scene = o.scene AND o.scene >= 0 AND q.bucket = o.bucket AND coalesce(""" + _IP.format(a="q.w", b="o.w") + " >= 0.6, false) AND coalesce(" + _IP.format(a="q.s", b="o.s") + """ >= 0.4, false)))) > 0
   THEN f.picks ELSE list_append(f.picks, {'id': o.id, 'bucket': o.bucket, 'scene': o.scene, 'digest': o.digest, 'w': o.w, 'p': o.p, 's': o.s}) END
 FROM f JOIN o ON o.shoot = f.shoot AND o.rn = f.rn + 1),
l AS (SELECT shoot, arg_max(picks, rn) AS picks FROM f GROUP BY 1), p AS (SELECT shoot, unnest(picks).id AS id, unnest(picks).bucket AS bucket, generate_subscripts(picks, 1) AS place FROM l)
SELECT shoot, id, bucket, CAST(place AS INT) AS place FROM p"""


@SELECTION.add("select_reframed", _REFRAMED)
def select_reframed(spark, sf):
    """Greedy picks above a score, none a duplicate by view, thumbnail and crop, or by reframing inside a scene.

    The tables hold one vector a photo; its first quarter stands for the thumbnail and its second half for the crop."""
    rows = scored(spark, sf, "bucket", "scene", "dino", "digest")
    whole = F.when((F.size("dino") >= 64) & ~F.exists("dino", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.slice("dino", 1, 64))
    rows = rows.withColumn("whole", whole).withColumn("pixels", F.slice("whole", 1, 16)).withColumn("crop", F.slice("whole", 33, 32))
    budgets = rows.select("shoot", "bucket").distinct().withColumn("budget", F.lit(5))
    return selection.greedy_select(rows, ["shoot"], "id", "bucket", "score", budgets, Rule(0.4, 0.8, 0.6), -0.5)


_COMPONENTS = _GREEDY.format(bucket="bucket", budget=3, sim=0.5).replace("SELECT shoot, id, bucket, CAST(place AS INT) AS place FROM p", """, e AS (SELECT a.shoot, a.id AS x, b.id AS y FROM p a JOIN p b ON a.shoot = b.shoot AND a.bucket <> b.bucket JOIN o ao ON ao.id = a.id JOIN o bo ON bo.id = b.id
  WHERE coalesce(ao.digest = bo.digest, false) OR (len(ao.v) = len(bo.v) AND coalesce(list_sum(list_transform(list_zip(ao.v, bo.v), lambda z: z[1] * z[2])) >= 0.3, false))),
r(shoot, id, root) AS (SELECT shoot, id, id FROM p UNION SELECT r.shoot, e.y, r.root FROM r JOIN e ON e.shoot = r.shoot AND e.x = r.id)
SELECT shoot, id, min(root) AS component FROM r GROUP BY 1, 2""")


@SELECTION.add("pick_components", _COMPONENTS)
def pick_components(spark, sf):
    """Picks of different buckets of a shoot that show nearly the same, as components of their graph."""
    rows = scored(spark, sf, "bucket", "dino", "digest")
    picks = _greedy(rows, "bucket", 3).select("shoot", "id", "bucket")
    views = rows.select("id", "digest", F.col("dino").alias("whole"))
    return duplicates.duplicate_components(picks.join(views, "id"), ["shoot"], "id", "bucket", Rule(0.3, reframe=0))


_SIGNALS = ["aesthetic", "focus", "editorial", "composition", "distinctiveness", "uncertainty"]


def _preselected(spark, sf):
    """The scored candidates without their vectors, and the shortlists of every shoot and bucket."""
    raw = table(spark, sf, "candidates").withColumn("look", F.xxhash64("dino"))
    rows = materialize(scored(spark, raw, "bucket", "scene", "burst", "moment", "digest", "look", *_SIGNALS), "scored")
    looks = raw.select(F.col("id").alias("item"), "look", F.col("dino").alias("whole"))
    n = rows.groupBy("shoot", "bucket").agg(F.count("*").alias("n")).withColumn("cap", sc.shortlist_cap(F.col("n"), sc.pick_budget(F.col("n"))))
    capped = rows.withColumnRenamed("id", "item").join(n.drop("n"), ["shoot", "bucket"])
    return rows, preselection.diverse_preselection(capped, ["shoot", "bucket"], "cap", looks=looks)


@SELECTION.add("diverse_preselection")
def diverse_preselection(spark, sf):
    """Of every shoot and bucket a shortlist for variety and quality, each row with its reason."""
    return _preselected(spark, sf)[1]


@SELECTION.add("quota_shortlist")
def quota_shortlist(spark, sf):
    """One collection-wide shortlist: square-root quotas per bucket, tied percentiles within shoots, a strict diverse selection per bucket."""
    rows = scored(spark, sf, "bucket", "scene", "burst", "moment", "digest", "dino", *_SIGNALS)
    ranked = scoring.mid_rank(rows, ["shoot", "bucket"], "score").drop("score").withColumnRenamed("mid_rank", "score")
    quota = selection.sqrt_quotas(ranked.groupBy("bucket").agg(F.count("*").alias("n")), "bucket", "n", 120).where("quota > 0")
    # scenes, moments and bursts are numbered within a shoot
    pool = ranked.join(quota, "bucket").withColumn("scene", F.concat_ws("#", "shoot", "scene")).withColumnsRenamed({"id": "item", "dino": "whole"})
    return preselection.diverse_preselection(pool, ["bucket"], "quota", strict=True)


def _burst_batches(keys):
    import pandas as pd

    def run(pdf):
        pdf = pdf.sort_values(["scene", "score", "id"], ascending=[True, False, True], kind="stable")
        block = [(s, b) if b >= 0 else i for s, b, i in zip(pdf.scene, pdf.burst.fillna(-1).astype(int), pdf.id)]
        got = selection.burst_chunks(list(pdf.id), block, 24)
        return pd.DataFrame([(i, n) for n, c in enumerate(got) for i in c], columns=["id", "chunk"])

    return run


@SELECTION.add("burst_chunks")
def burst_chunks(spark, sf):
    """Batches that keep bursts together, of what the shortlists of each shoot and bucket hold."""
    return _chunked(*_preselected(spark, sf))


def _chunked(rows, picks):
    """Batches of 24 of the shortlists; what fits one batch is one."""
    keys = ["shoot", "bucket"]
    short = materialize(picks.select(*keys, F.col("item").alias("id")), "short")
    sized = short.join(short.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    one = sized.where("n <= 24").select("id", F.lit(0).alias("chunk"))
    pool = sized.where("n > 24").select("id", *keys).join(rows.select("id", "scene", "burst", "score"), "id")
    batches = _burst_batches(keys)

    def run(frames):
        import pandas as pd

        for group in preselection.grouped(frames, keys):
            yield batches(pd.DataFrame(group))

    return one.unionByName(spread(pool, *keys).sortWithinPartitions(*keys).mapInPandas(run, "id string, chunk int"))


@SELECTION.add(
    "judged_selection",
    C + """, t AS (SELECT *, row_number() OVER (PARTITION BY shoot, bucket, coalesce(nullif(digest, ''), chr(1) || id) ORDER BY score DESC, id) AS copy,
  first_value(id) OVER (PARTITION BY shoot, bucket, coalesce(nullif(digest, ''), chr(1) || id) ORDER BY score DESC, id) AS keeper FROM k),
n AS (SELECT shoot, bucket, least(5 + count(*) // 40, 15) AS budget FROM k GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY shoot, bucket ORDER BY copy > 1, score DESC, id) AS place FROM t)
SELECT shoot, id, copy = 1 AND place <= budget AS selected, CASE WHEN copy > 1 THEN '= identical copy of ' || regexp_extract(keeper, '([^/]*)$', 1) WHEN place <= budget THEN 'Selected by judge' ELSE 'Not selected' END AS decision FROM r JOIN n USING (shoot, bucket)""",
)
def judged_selection(spark, sf):
    """Every candidate judged in batches of its bucket, copies folded, by the ranker that goes by score: the winners are the bucket's best."""
    rows = scored(spark, sf, "bucket", "scene", "digest")
    budgets = rows.groupBy("shoot", "bucket").agg(sc.pick_budget(F.count("*")).alias("k"))
    twins = similarity.exact_twins(rows, "id", "digest", "score", ["shoot", "bucket"])
    single = twins.where("id = keeper").select("id").join(rows.drop("digest"), "id").join(budgets, ["shoot", "bucket"])
    batches = selection.balanced_chunks(single, ["shoot", "bucket"], [F.col("scene"), F.desc("score"), F.col("id")], 36)
    judged = judging.judged_tournament(batches.withColumnsRenamed({"id": "item", "chunk": "batch"}), ["shoot", "bucket"], "k", chunk=36)
    told = F.when(F.col("place").isNotNull(), "Selected by judge").otherwise("Not selected")
    out = judged.select("shoot", F.col("item").alias("id"), F.col("place").isNotNull().alias("selected"), told.alias("decision"))
    copies = twins.where("id <> keeper").select("shoot", "id", F.lit(False).alias("selected"), F.concat(F.lit("= identical copy of "), F.regexp_extract("keeper", r"([^/]*)$", 1)).alias("decision"))
    return out.unionByName(copies)


@SELECTION.add("award_roll")
def award_roll(spark, sf):
    """One roll of 24 over the whole collection: copies folded, a strict shortlist by label quotas, batches that keep bursts together, a
    tournament of twice the roll, and a final comparison; every candidate with its rank and decision."""
    rows = scored(spark, sf, "bucket", "scene", "burst", "moment", "digest", "dino", *_SIGNALS)
    twins = similarity.exact_twins(rows, "id", "digest", "score")
    copies = twins.where("id <> keeper").select("id", F.concat(F.lit("= identical copy of "), F.regexp_extract("keeper", r"([^/]*)$", 1)).alias("decision"))
    short = quota_shortlist(spark, sf).select(F.col("item").alias("id")).join(copies, "id", "left_anti")
    # at most the 120 slots of the shortlist
    pool = materialize(short.join(rows.select("id", "shoot", "bucket", "scene", "burst", "score"), "id").withColumn("k", F.lit(48)), "shortlist")
    batches = pool.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_burst_batches(["all"]), "id string, chunk int")
    rows_of = pool.join(batches, "id").withColumn("all", F.lit(0)).withColumnsRenamed({"id": "item", "chunk": "batch"})
    finalists = judging.judged_tournament(rows_of, ["all"], "k")
    last = rows_of.drop("batch", "k").join(finalists.where("place IS NOT NULL").select("item"), "item").withColumn("batch", F.lit(0)).withColumn("k", F.lit(24))
    final = judging.judged_round(last, ["all"], "k", judging.by_score, True)
    lost = finalists.where("place IS NULL").select(F.col("item").alias("id"), F.lit(None).cast("int").alias("rank"), F.col("reason").alias("decision"))
    told = F.when(F.col("place").isNotNull(), F.concat(F.lit("Award roll #"), F.col("place").cast("string"))).otherwise(F.col("reason"))
    seen = final.select(F.col("item").alias("id"), F.col("place").alias("rank"), told.alias("decision")).unionByName(lost).unionByName(copies.withColumn("rank", F.lit(None).cast("int")))
    return rows.select("id").join(seen, "id", "left").select("id", "rank", F.coalesce("decision", F.lit("Outside judge shortlist")).alias("decision"))
