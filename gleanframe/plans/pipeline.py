"""The selection of photos end to end: scores, rejections, budgets, greedy picks without near copies, and a reason for every row."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanframe.functions import scalars as sc
from gleanframe.functions import vectors
from gleanframe.operators import duplicates, refine, scoring, selection
from gleanframe.operators.duplicates import Rule
from gleanframe.plans.registry import Registry, table
from gleanframe.plans.review import SEL, selections, votes
from gleanframe.plans.scoring import _SCORE, U, photos, r6
from gleanframe.plans.selection import C, scored
from gleanframe.session import materialize

PIPELINE = Registry()
SIMILAR, CUTOFF = 0.9, -0.5

_IP = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
_SELECT = "WITH RECURSIVE " + U[5:-1] + _SCORE + f""", w AS (SELECT photo_id, day, coalesce(label, 'none') AS label, reject, score,
  CASE WHEN len(dino) = 64 AND len(list_filter(dino, lambda x: x <> 0)) > 0 THEN list_transform(coalesce(dino, []), lambda x: CAST(x AS DOUBLE)) END AS v0 FROM s),
x AS (SELECT * EXCLUDE (v0), list_transform(v0, lambda x: x / sqrt({_IP.format(a='v0', b='v0')})) AS v FROM w),
bud AS (SELECT day, label, least(5 + count(*) // 40, 15) AS budget FROM x WHERE reject = '' GROUP BY 1, 2),
o AS (SELECT x.*, budget, row_number() OVER (PARTITION BY x.day ORDER BY score DESC, photo_id) AS rn FROM x JOIN bud USING (day, label) WHERE reject = '' AND score >= {CUTOFF}),
f(day, rn, picks) AS (SELECT day, 0, CAST([] AS STRUCT(id BIGINT, label VARCHAR, v DOUBLE[])[]) FROM (SELECT DISTINCT day FROM o) UNION ALL
 SELECT o.day, o.rn, CASE WHEN len(list_filter(f.picks, lambda p: p.label = o.label)) >= o.budget OR len(list_filter(f.picks, lambda p: coalesce({_IP.format(a='p.v', b='o.v')} >= {SIMILAR}, false))) > 0
   THEN f.picks ELSE list_append(f.picks, {{'id': o.photo_id, 'label': o.label, 'v': o.v}}) END FROM f JOIN o ON o.day = f.day AND o.rn = f.rn + 1),
l AS (SELECT day, arg_max(picks, rn) AS picks FROM f GROUP BY 1)
SELECT photo_id, reject = '' AND len(list_filter(coalesce(picks, []), lambda p: p.id = photo_id)) > 0 AS selected,
 CASE WHEN reject <> '' THEN 'Rejected: ' || reject WHEN len(list_filter(coalesce(picks, []), lambda p: p.id = photo_id)) > 0 THEN 'Selected by score' WHEN coalesce(score < {CUTOFF}, true) THEN 'Below requested score cutoff'
 WHEN len(list_filter(coalesce(picks, []), lambda p: coalesce({_IP.format(a='p.v', b='x.v')} >= {SIMILAR}, false))) > 0
 THEN 'Similar to selected ' || list_min(list_transform(list_filter(coalesce(picks, []), lambda p: coalesce({_IP.format(a='p.v', b='x.v')} >= {SIMILAR}, false)), lambda p: p.id)) ELSE 'Group budget filled' END AS decision
FROM x LEFT JOIN l USING (day)"""  # fmt: skip


@PIPELINE.add("select_photos", _SELECT)
def select_photos(spark, sf):
    """Every photo with ``selected`` and ``decision``: picks per day and label above a cutoff and under budgets, none a near copy of another pick of
    its day."""
    rows = photos(spark, sf, "day", "label", "aesthetic", "sharpness", "subject_sharpness", "clip_high", "clip_low", "subject", "edge", "composition_bonus", "reject", "dino")
    rows = scoring.score(rows, ["day", "label"]).withColumn("label", F.coalesce("label", F.lit("none")))
    # four plans below read the scored rows; they are made once
    rows = materialize(rows.select("photo_id", "day", "label", "score", "reject", F.when(F.size("dino") == 64, F.col("dino")).alias("whole")), "scored")
    open_rows = rows.where("reject = ''")
    budgets = open_rows.groupBy("day", "label").agg(sc.pick_budget(F.count("*")).alias("budget"))
    rule = Rule(SIMILAR, reframe=0)
    picks = selection.greedy_select(open_rows, ["day"], "photo_id", "label", "score", budgets, rule, CUTOFF).select("photo_id", F.lit(True).alias("picked"))
    picks = materialize(picks, "picked")
    left_out = open_rows.where(F.col("score") >= CUTOFF).join(picks, "photo_id", "left_anti")
    like = duplicates.resembled(left_out, open_rows.join(picks, "photo_id", "left_semi"), ["day"], "photo_id", rule, "label").select("photo_id", "like")
    r = rows.join(picks, "photo_id", "left").join(like, "photo_id", "left").withColumn("selected", F.coalesce("picked", F.lit(False)))
    text = F.when(F.col("reject") != "", F.concat(F.lit("Rejected: "), "reject")).when(F.col("selected"), "Selected by score")
    text = text.when(F.coalesce(F.col("score") < CUTOFF, F.lit(True)), "Below requested score cutoff").when(F.col("like").isNotNull(), F.concat(F.lit("Similar to selected "), F.col("like").cast("string"))).otherwise("Group budget filled")
    return r.select("photo_id", "selected", text.alias("decision"))


@PIPELINE.add(
    "close_focus",
    C + """, l AS (SELECT *, row_number() OVER m AS n, first_value(score) OVER m AS top, first_value(score - focus) OVER m AS free FROM k WINDOW m AS (PARTITION BY shoot, bucket, moment ORDER BY score DESC, id)),
r AS (SELECT *, row_number() OVER (PARTITION BY shoot, bucket, moment ORDER BY score DESC, id) AS i FROM l WHERE n = 1 OR (top - score <= 1 AND abs(free - (score - focus)) <= 0.5)),
s AS (SELECT shoot, bucket, moment, count(*) AS m, max(top) AS top FROM r WHERE i <= 3 GROUP BY 1, 2, 3 HAVING count(*) >= 2),
t AS (SELECT shoot, bucket, moment, 12 - coalesce(sum(m) OVER (PARTITION BY shoot, bucket ORDER BY top DESC, moment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM s)
SELECT shoot, id, CAST(i AS INT) AS place FROM r JOIN t USING (shoot, bucket, moment) WHERE room >= 2 AND i <= 3 AND i <= room""",
)
def close_focus(spark, sf):
    rows = scored(spark, sf, "bucket", "moment", "focus").withColumn("free", F.col("score") - F.col("focus"))
    return refine.close_focus_candidates(rows, ["shoot", "bucket"], "moment", "id", "score", "free").select("shoot", "id", "place")


@PIPELINE.add(
    "editorial_margins",
    C + """, g AS (SELECT id, CASE WHEN len(dino) = 64 THEN list_transform(coalesce(dino, []), lambda x: CAST(x AS DOUBLE)) END AS v FROM c)
SELECT id, round(v[1] - v[2], 6) AS light, round(v[3] - v[4], 6) AS moment, round((v[1] - v[2] + v[3] - v[4]) / 2, 6) AS mean_margin FROM g""",
)
def editorial_margins(spark, sf):
    """Margins against stated pairs of text vectors, here unit vectors of the first dimensions."""
    axis = lambda i: [float(j == i) for j in range(64)]
    rows = table(spark, sf, "candidates").select("id", "dino").dropDuplicates(["id"])
    m = vectors.margins(F.col("dino"), [("light", axis(0), axis(1)), ("moment", axis(2), axis(3))])
    return rows.select("id", *[r6(c, n) for n, c in m.items()])


@PIPELINE.add(
    "forced_items",
    SEL + """SELECT DISTINCT id FROM sel WHERE lower(regexp_replace(regexp_extract(id, '([^/]*)$', 1), '\\.[^.]*$', '')) IN ('f000001', 'f000002', 'p00000015')""",
)
def forced_items(spark, sf):
    from gleanframe.functions import texts

    wanted = spark.createDataFrame([("F000001.JPG",), ("f000002",), ("p00000015.nef",), ("nosuch",)], "name string")
    found, _ = refine.forced(selections(spark, sf), "id", wanted, texts.stem(F.col("id")))
    return found.select("id").distinct()


@PIPELINE.add(
    "suffix_matches",
    SEL + r""", d AS (SELECT DISTINCT CASE WHEN place % 2 = 0 THEN id ELSE regexp_extract(id, '([^/]*)$', 1) END AS file FROM sel), q AS (SELECT DISTINCT '/archive/x/' || id AS path FROM sel),
t AS (SELECT path, split(path, '/') AS parts FROM q), o AS (SELECT DISTINCT path, array_to_string(parts[i:], '/') AS tail FROM (SELECT path, parts, unnest(range(2, len(parts) + 1)) AS i FROM t)),
m AS (SELECT path, count(*) AS n, min(file) AS f FROM o JOIN d ON tail = file GROUP BY 1) SELECT q.path, CASE WHEN n = 1 THEN f END AS file, coalesce(n, 0) AS matches FROM q LEFT JOIN m USING (path)""",
)
def suffix_matches(spark, sf):
    """Of all files and paths of every shoot: every second file is declared by its path, the others by name."""
    from gleanframe.functions import texts

    s = selections(spark, sf, every_place=True).select("id", "place")
    declared = s.select(F.when(F.col("place") % 2 == 0, F.col("id")).otherwise(texts.base_name(F.col("id"))).alias("file"))
    return refine.match_suffix(s.select(F.concat(F.lit("/archive/x/"), "id").alias("path")), "path", declared, "file")


_CAPPED = "WITH RECURSIVE " + SEL[5:] + """, w AS (SELECT shoot, winner AS id, count(*) AS wins FROM v WHERE winner IS NOT NULL GROUP BY 1, 2),
o AS (SELECT w.shoot, w.id, lower(trim(coalesce(s.label, ''))) AS k, lower(trim(coalesce(CAST(s.scene AS VARCHAR), ''))) AS d, row_number() OVER (PARTITION BY w.shoot ORDER BY wins DESC, w.id) AS rn FROM w JOIN sel s ON s.id = w.id),
f(shoot, rn, id, why, held) AS (SELECT shoot, 0, CAST(NULL AS VARCHAR), '', CAST([] AS STRUCT(k VARCHAR, d VARCHAR)[]) FROM (SELECT DISTINCT shoot FROM o) UNION ALL
 SELECT shoot, rn, id, why, CASE WHEN why = '' THEN list_append(held, {'k': k, 'd': d}) ELSE held END FROM (
  SELECT o.shoot, o.rn, o.id, o.k, o.d, f.held, CASE WHEN o.k = '' THEN 'no kind' WHEN o.d = '' THEN 'no detail'
    WHEN len(list_filter(f.held, lambda h: h.k = o.k)) >= 2 OR len(list_filter(f.held, lambda h: h.k = o.k AND h.d = o.d)) > 0 THEN 'repeated kind' WHEN len(f.held) >= 12 THEN 'limit reached' ELSE '' END AS why
  FROM f JOIN o ON o.shoot = f.shoot AND o.rn = f.rn + 1))
SELECT shoot, id AS item, why = '' AS kept, why AS reason FROM f WHERE id IS NOT NULL"""


@PIPELINE.add("capped_winners", _CAPPED)
def capped_winners(spark, sf):
    """Winners of a shoot's votes by number of wins: at most two of a label, the second from another scene, twelve in all."""
    wins = votes(spark, sf).where("winner IS NOT NULL").groupBy("shoot", F.col("winner").alias("id")).agg(F.count("*").alias("wins"))
    rows = wins.join(selections(spark, sf).select("id", "label", F.col("scene").cast("string").alias("scene")), "id")
    return refine.capped_picks(rows.withColumn("o", -F.col("wins")), ["shoot"], "o", "id", "label", "scene", F.lit(True), 2, 12)
