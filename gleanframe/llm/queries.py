"""Queries of the training-data operators over the whole test tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanframe.llm import clusters, leakage, leximin, packing, pairwise, prose, survivor, topn, varied
from gleanframe.plans.registry import Registry, table

LLM = Registry()

# ---- 1: global ranking from pairwise comparisons ---------------------------------------------------------------------------------------


def _strengths(spark, sf, **how):
    votes = table(spark, sf, "preferences").select("seq", "shoot", "winner", "loser")
    return pairwise.rank_comparisons(votes, "shoot", "winner", "loser", "seq", **how)


@LLM.add("p1_found")
def p1_found(spark, sf):
    return _strengths(spark, sf, head=12).select("shoot", F.col("item").alias("id")).distinct()


@LLM.add("p1_strengths")
def p1_strengths(spark, sf):
    out = _strengths(spark, sf)
    return out.select("shoot", F.col("item").alias("id"), "place", F.round("strength", 4).alias("strength"), F.round("std_error", 4).alias("std_error"), "wins", "losses", "component", "components")


# ---- 2: best representative of each duplicate group -------------------------------------------------------------------------------

_P2 = """
WITH r AS (SELECT DISTINCT rec_no, shoot, id, nullif(burst, -1) AS burst, CASE WHEN isnan(score) THEN NULL ELSE score END AS score,
                  CASE WHEN isnan(focus) THEN NULL ELSE focus END AS focus, run_at FROM candidate_records WHERE id IS NOT NULL),
v AS (SELECT shoot, id,
        arg_max(burst, {'t': run_at, 'r': rec_no}) FILTER (burst IS NOT NULL) AS burst,
        arg_max(score, {'t': run_at, 'r': rec_no}) FILTER (score IS NOT NULL) AS score,
        arg_max(focus, {'t': run_at, 'r': rec_no}) FILTER (focus IS NOT NULL) AS focus
      FROM r GROUP BY shoot, id),
k AS (SELECT *, row_number() OVER (PARTITION BY shoot, burst ORDER BY score DESC NULLS LAST, focus DESC NULLS LAST, id) AS rn,
        count(*) OVER (PARTITION BY shoot, burst) AS n FROM v WHERE burst IS NOT NULL AND shoot IS NOT NULL)
SELECT shoot, burst, id FROM k WHERE rn = 1 AND n >= 2
"""


def _records(spark, sf):
    return table(spark, sf, "candidate_records").select("rec_no", "id", "shoot", "burst", "score", "focus", "origin", "run_at")


@LLM.add("p2_found", _P2)
def p2_found(spark, sf):
    one = survivor.fuse(_records(spark, sf), ["shoot", "id"], {"burst": ["burst"], "score": ["score"], "focus": ["focus"]}, "run_at", ["rec_no"], {"burst": -1})
    return survivor.survivors(one, ["shoot", "burst"], "id", ["score", "focus"]).distinct()


_WORTH = "{x}.n + CASE WHEN {x}.t IS NULL THEN 0.0 ELSE 0.01 + 0.98 * ({x}.t - s.lo) / greatest(s.hi - s.lo, 1e-9) END"
_P2_BUNDLES = f"""
WITH r AS (SELECT DISTINCT rec_no, shoot, id, nullif(burst, -1) AS burst, CASE WHEN isnan(score) THEN NULL ELSE score END AS score,
             CASE WHEN isnan(focus) THEN NULL ELSE focus END AS focus, origin, CAST(epoch_us(run_at) AS DOUBLE) AS t FROM candidate_records WHERE id IS NOT NULL AND shoot IS NOT NULL),
rule AS (SELECT shoot, burst, arg_min(origin, {{'n': -n, 'o': origin}}) AS origin FROM (SELECT shoot, burst, origin, count(*) AS n FROM r WHERE burst IS NOT NULL AND origin IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
s AS (SELECT shoot, id, min(t) AS lo, max(t) AS hi FROM r GROUP BY 1, 2),
p AS (SELECT shoot, id, r.burst, rule.origin AS need, CAST(2 AS DOUBLE) AS n, t, row_number() OVER (PARTITION BY shoot, id ORDER BY t DESC NULLS LAST, rec_no DESC, r.burst DESC) AS rk
      FROM r JOIN rule USING (shoot, burst) UNION ALL
      SELECT shoot, id, r.burst, NULL, 2, t, 1000 + row_number() OVER (PARTITION BY shoot, id ORDER BY t DESC NULLS LAST, rec_no DESC) FROM r WHERE burst IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rule WHERE rule.shoot = r.shoot AND rule.burst = r.burst)),
a AS (SELECT shoot, id, score, focus, origin, CAST((score IS NOT NULL)::INT + (focus IS NOT NULL)::INT + (origin IS NOT NULL)::INT AS DOUBLE) AS n, t,
        row_number() OVER (PARTITION BY shoot, id ORDER BY (score IS NOT NULL)::INT + (focus IS NOT NULL)::INT + (origin IS NOT NULL)::INT DESC, t DESC NULLS LAST, rec_no DESC) AS rk
      FROM r WHERE score IS NOT NULL OR focus IS NOT NULL OR origin IS NOT NULL),
f AS (SELECT s.shoot, s.id, p.burst, a.score, a.focus, a.origin, coalesce(p.rk, 99999) AS pr, coalesce(a.rk, 99999) AS ar,
        (CASE WHEN p.n IS NULL THEN 0.0 ELSE {_WORTH.format(x="p")} END) + (CASE WHEN a.n IS NULL THEN 0.0 ELSE {_WORTH.format(x="a")} END) AS total, p.need IS NULL OR a.origin IS NULL OR p.need = a.origin AS fits
      FROM s LEFT JOIN (SELECT * FROM p UNION ALL SELECT shoot, id, NULL, NULL, NULL, NULL, NULL FROM s) p ON p.shoot = s.shoot AND p.id = s.id
             LEFT JOIN (SELECT * FROM a UNION ALL SELECT shoot, id, NULL, NULL, NULL, NULL, NULL, NULL FROM s) a ON a.shoot = s.shoot AND a.id = s.id),
k AS (SELECT *, row_number() OVER (PARTITION BY shoot, id ORDER BY round(total, 9) DESC, pr, ar) AS pick FROM f WHERE fits),
x AS (SELECT shoot, id, bool_and(fits) FILTER (pr IN (1, 1001) AND ar = 1) AS calm FROM f GROUP BY 1, 2)
SELECT shoot, id, burst, score, focus, origin, NOT coalesce(calm, true) AS branched FROM k JOIN x USING (shoot, id) WHERE pick = 1
"""


@LLM.add("p2_bundles", _P2_BUNDLES)
def p2_bundles(spark, sf):
    """Of each photo a burst and an analysis (score, focus and their origin), each whole from one record, so that the photos of a burst can
    be compared: a burst allows only the origin most of its records have. Photos whose best burst and best analysis disagree are branched on."""
    view = F.when(F.col("burst").isNotNull() & (F.col("burst") != -1) & F.col("shoot").isNotNull(), F.concat_ws("#", "shoot", "burst"))
    rows = _records(spark, sf).withColumn("view", view)
    bundles = {"place": ["burst", "view"], "analysis": ["score", "focus", "origin"]}
    out = survivor.fuse(rows, ["shoot", "id"], bundles, "run_at", ["rec_no"], {"burst": -1}, [("view", "origin")], mark="branched")
    return out.drop("view")


# ---- 3: top N items within every group ---------------------------------------------------------------------------------------------

_P3 = """
WITH c AS (SELECT shoot, lower(trim(bucket, E' \\t\\n\\r')) AS bucket, scene, id, max(score) AS score FROM candidates
           WHERE shoot IS NOT NULL AND bucket IS NOT NULL AND trim(bucket, E' \\t\\n\\r') <> '' AND score IS NOT NULL AND NOT isnan(score)
             AND scene IS NOT NULL AND scene <> -1 AND id IS NOT NULL GROUP BY 1, 2, 3, 4),
k AS (SELECT *, row_number() OVER (PARTITION BY shoot, bucket, scene ORDER BY score DESC, id) AS rank FROM c)
"""


def _top3(spark, sf):
    rows = table(spark, sf, "candidates").select("id", "shoot", "bucket", "score", "scene")
    bucket = F.lower(F.regexp_replace("bucket", r"(?U)^\s+|\s+$", ""))
    return topn.top_n(rows, ["shoot", bucket, "scene"], "id", "score", 3, (F.col("scene") != -1) & (bucket != ""), ["shoot", "bucket", "scene"])


@LLM.add("p3_found", _P3 + "SELECT shoot, bucket, scene, id FROM k WHERE rank <= 3")
def p3_found(spark, sf):
    return _top3(spark, sf).select("shoot", "bucket", "scene", "id").distinct()


@LLM.add("p3_ranked", _P3 + "SELECT shoot, bucket, scene, id, score, rank FROM k WHERE rank <= 3")
def p3_ranked(spark, sf):
    return _top3(spark, sf)


# ---- 6: one ranking from several differently scaled scores ---------------------------------------------------------------------------

SCORES = ["sharpness", "aesthetic", "composition_bonus", "subject_sharpness"]


def _ranking_sql() -> str:
    p = ", ".join(
        f"CASE WHEN {s} IS NULL THEN 0.0 ELSE (rank() OVER (PARTITION BY shoot ORDER BY {s} NULLS LAST) - 1 + "
        f"(count({s}) OVER (PARTITION BY shoot, {s}) + 1) / 2.0 - 0.5) / count({s}) OVER (PARTITION BY shoot) END AS p{i}"
        for i, s in enumerate(SCORES)
    )
    m = ", ".join(f"max(CASE WHEN isnan({s}) THEN NULL ELSE {s} END) AS {s}" for s in SCORES)
    return f"""
WITH u AS (SELECT shoot, photo_id, {m} FROM photos WHERE shoot IS NOT NULL AND photo_id IS NOT NULL GROUP BY 1, 2),
p AS (SELECT shoot, photo_id, {p} FROM u),
r AS (SELECT shoot, photo_id, list_sort([p0, p1, p2, p3]) AS vector FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY shoot ORDER BY vector DESC, photo_id) AS place FROM r)
"""


def _scored(spark, sf):
    return table(spark, sf, "photos").select("shoot", "photo_id", *SCORES)


@LLM.add("p6_found", _ranking_sql() + "SELECT shoot, photo_id FROM k WHERE place <= 5")
def p6_found(spark, sf):
    return leximin.leximin_rank(_scored(spark, sf), "shoot", "photo_id", SCORES, head=5).select("shoot", "photo_id").distinct()


@LLM.add("p6_ranking", _ranking_sql() + "SELECT shoot, photo_id, round(vector[1], 9) AS weakest, place FROM k")
def p6_ranking(spark, sf):
    out = leximin.leximin_rank(_scored(spark, sf), "shoot", "photo_id", SCORES)
    return out.select("shoot", "photo_id", F.round("weakest", 9).alias("weakest"), "place")


# ---- 8: filling fixed-capacity containers ------------------------------------------------------------------------------------------


# loss-bearing tokens and segments a container may hold beside its 2,048 tokens
LOSS, SEGMENTS = 1792, 16


def _packed(spark, sf, **how):
    return packing.pack(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", **how)


@LLM.add("p8_found")
def p8_found(spark, sf):
    return _packed(spark, sf).where("pieces > 1").select("doc_id").distinct()


@LLM.add("p8_containers")
def p8_containers(spark, sf):
    """Containers under three limits of which each is reached by some: tokens, segments and loss-bearing tokens."""
    out = _packed(spark, sf, max_segments=SEGMENTS, max_loss=LOSS).groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("segments"), F.sum("loss").alias("loss_tokens"))
    return out.withColumn("room", 2048 - F.col("tokens"))


# ---- 10: per-document text quality statistics ----------------------------------------------------------------------------------------


@LLM.add("p10_found")
def p10_found(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    # the verdict is aggregated before it is filtered: a filter on it would be pushed below and compute every statistic again for each rule
    return prose.judge(docs, "doc_id", "text").groupBy("doc_id").agg(F.max("junk").alias("junk")).where("junk").select("doc_id")


@LLM.add("p10_statistics")
def p10_statistics(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return prose.judge(docs, "doc_id", "text")


# ---- 9: evaluation texts leaking into training text ----------------------------------------------------------------------------------


def _leaks(spark, sf, **how):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    items = table(spark, sf, "eval_items").select("item_id", "passage")
    return leakage.leaks(docs, "doc_id", "text", items, "item_id", "passage", **how)


@LLM.add("p9_found")
def p9_found(spark, sf):
    return _leaks(spark, sf).where("run >= 12").select("doc_id", "item_id").distinct()


@LLM.add("p9_paraphrases")
def p9_paraphrases(spark, sf):
    """Documents that tell a passage in other words, without a run of twelve: a good part of its words in order and of its answers.

    Passages of these tables share their phrasing and differ in names and numbers, so the answers decide; few documents remain.
    """
    out = _leaks(spark, sf, width=8, stride=4, cosine=0.55, confirm=0.45)
    return out.where("run < 12 AND subsequence >= 0.3 AND answers >= 0.3").select("doc_id", "item_id", F.round("subsequence", 4).alias("subsequence"), F.round("answers", 4).alias("answers"))


# ---- 7: grouping records into similarity clusters --------------------------------------------------------------------------------------


def _looks(spark, sf):
    return clusters.alike_clusters(table(spark, sf, "photos").select("photo_id", "dino"), "photo_id", "dino")


_P7 = """
WITH d AS (SELECT DISTINCT photo_id, dino FROM photos WHERE photo_id IS NOT NULL AND len(dino) = 64 AND len(list_filter(dino, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(dino, lambda x: x <> 0)) > 0),
v AS (SELECT photo_id, CAST(list_transform(dino, lambda x: CAST(x AS DOUBLE)) AS DOUBLE[64]) AS v FROM d),
n AS (SELECT a.photo_id, list_sort(list(b.photo_id)) AS near FROM v a JOIN v b ON array_cosine_similarity(a.v, b.v) >= 0.9 GROUP BY 1),
g AS (SELECT near FROM n GROUP BY 1 HAVING count(*) = len(near) AND count(*) >= 2)
"""


@LLM.add("p7_found", _P7 + "SELECT photo_id, near[1] AS cluster_id FROM n JOIN g USING (near)")
def p7_found(spark, sf):
    return _looks(spark, sf).where("alike AND size >= 2").select("photo_id", "cluster_id").distinct()


@LLM.add("p7_typical")
def p7_typical(spark, sf):
    return clusters.typical(_looks(spark, sf), "photo_id")


@LLM.add("p7_groups")
def p7_groups(spark, sf):
    """k-means groups of looks in which a common scene and moment count too, with their most typical photos."""
    rows = table(spark, sf, "photos").select("photo_id", "dino", F.concat_ws("#", "shoot", "scene").alias("scene"), F.concat_ws("#", "shoot", "scene", "moment").alias("moment"))
    k = max(16, int(rows.count() ** 0.5))
    return clusters.kmeans_groups(rows, "photo_id", "dino", {"scene": 0.35, "moment": 0.25}, k)


# ---- 5: choosing a varied subset --------------------------------------------------------------------------------------------------------


@LLM.add("p5_subset")
def p5_subset(spark, sf):
    """Of every shoot's candidates as many as the shoot asks keepers for, spread over views, buckets and moments."""
    rows = table(spark, sf, "candidates").select("shoot", "id", "dino", "score", "moment", F.lower(F.regexp_replace("bucket", r"(?U)^\s+|\s+$", "")).alias("bucket"))
    sizes = table(spark, sf, "shoots").select("shoot", F.col("keepers").alias("size"))
    return varied.varied_subset(rows, "shoot", "id", "dino", "score", ["bucket", "moment"], sizes)
