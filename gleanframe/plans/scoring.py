"""Queries on row-local expressions, group-normalised scores, labels and sequences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gleanframe.functions import scalars as sc
from gleanframe.functions import texts, vectors
from gleanframe.operators import scoring, sequence, similarity
from gleanframe.plans.registry import Registry, table
from gleanframe.session import materialize

SCORING = Registry()

COLUMNS = [
    "photo_id", "path", "shoot", "camera", "time", "scene", "moment", "burst", "label", "label_prob", "sharpness", "aesthetic", "composition_bonus",
    "subject_sharpness", "clip_low", "clip_high", "person", "subject", "edge", "iso", "reject", "dino",
]
# the columns in SQL: photos delivered again count once
U = f"WITH u AS (SELECT DISTINCT ON (photo_id) {', '.join(COLUMNS)}, coalesce(strftime(time, '%Y-%m-%d'), 'unknown-date') AS day FROM photos ORDER BY photo_id) "


def photos(spark, sf, *columns):
    """Distinct photos with their day; only the columns asked for are read."""
    want = [c for c in COLUMNS if c in columns or c == "photo_id"]
    more = ["time"] if "day" in columns and "time" not in want else []
    rows = table(spark, sf, "photos").select(*want, *more).dropDuplicates(["photo_id"])
    if "day" in columns:
        rows = rows.withColumn("day", F.coalesce(F.date_format("time", "yyyy-MM-dd"), F.lit("unknown-date")))
    return rows.drop(*more) if more else rows


def r6(c, name=None):
    return F.round(c if not isinstance(c, str) else F.col(c), 6).alias(name or c)


@SCORING.add(
    "score_group_z",
    U + """SELECT photo_id, round(CASE WHEN stddev_pop(aesthetic) OVER w > 1e-6 THEN (aesthetic - avg(aesthetic) OVER w) / stddev_pop(aesthetic) OVER w
    WHEN aesthetic IS NOT NULL THEN 0 END, 6) AS z FROM u WINDOW w AS (PARTITION BY day, label)""",
)
def score_group_z(spark, sf):
    rows = photos(spark, sf, "day", "label", "aesthetic")
    rows = scoring.with_stats(rows, ["day", "label"], m=F.avg("aesthetic"), s=F.stddev_pop("aesthetic"))
    return rows.select("photo_id", r6(scoring.z(F.col("aesthetic"), F.col("m"), F.col("s")), "z"))


_SCORE = """, b AS (SELECT *, subject_sharpness IS NOT NULL AS ons, ln(1 + coalesce(subject_sharpness, sharpness)) AS lf FROM u),
z AS (SELECT *, CASE WHEN stddev_pop(lf) OVER f > 1e-6 THEN (lf - avg(lf) OVER f) / stddev_pop(lf) OVER f ELSE 0 END AS fr,
        coalesce(CASE WHEN stddev_pop(aesthetic) OVER g > 1e-6 THEN (aesthetic - avg(aesthetic) OVER g) / stddev_pop(aesthetic) OVER g ELSE 0 END, 0) AS az
      FROM b WINDOW f AS (PARTITION BY day, label, ons), g AS (PARTITION BY day, label)),
s AS (SELECT *, 0.6 * az + 0.4 * coalesce(fr, 0) - (3 * greatest(clip_high - 0.02, 0) + 2 * greatest(clip_low - 0.10, 0))
        + CASE WHEN coalesce(subject, 0) > 0 THEN 0.4 * (least(greatest(log10(subject / 0.01), 0), 1.5) - CASE WHEN coalesce(edge, false) AND subject < 0.15 THEN 1 ELSE 0 END) ELSE 0 END
        + coalesce(composition_bonus, 0) AS score FROM z)
"""


def scored(spark, sf):
    rows = photos(spark, sf, "day", "shoot", "label", "scene", "moment", "burst", "aesthetic", "sharpness", "subject_sharpness", "clip_high", "clip_low", "subject", "edge", "composition_bonus", "reject", "path")
    return scoring.score(rows, ["day", "label"])


@SCORING.add("score_photos", U[:-1] + _SCORE + "SELECT photo_id, round(coalesce(fr, 0), 6) AS focus_rank, round(score, 6) AS score FROM s")
def score_photos(spark, sf):
    return scored(spark, sf).select("photo_id", r6("focus_rank"), r6("score"))


@SCORING.add(
    "reject_case",
    U[:-1] + """, m AS (SELECT *, CASE WHEN scene >= 0 AND count(*) OVER w >= 3 THEN coalesce(median(sharpness) OVER w, 0) ELSE 0 END AS med FROM u WINDOW w AS (PARTITION BY shoot, scene))
SELECT photo_id, round(med, 6) AS scene_median, CASE WHEN label IN ('screenshot or document') THEN 'label' WHEN sharpness < 20 OR sharpness < 0.15 * med THEN 'blurry'
WHEN clip_high > 0.4 OR clip_low > 0.6 THEN 'exposure' ELSE '' END AS reason FROM m""",
)
def reject_case(spark, sf):
    rows = scoring.scene_medians(photos(spark, sf, "shoot", "scene", "label", "sharpness", "clip_high", "clip_low"), ["shoot", "scene"], "sharpness")
    reason = scoring.reject_reason(F.col("label"), F.col("sharpness"), F.col("scene_median"), F.col("clip_high"), F.col("clip_low"), ["screenshot or document"])
    return rows.select("photo_id", r6("scene_median"), reason.alias("reason"))


@SCORING.add(
    "subject_term",
    U + """SELECT photo_id, round(CASE WHEN coalesce(subject, 0) > 0 THEN 0.4 * (least(greatest(log10(subject / 0.01), 0), 1.5) - CASE WHEN coalesce(edge, false) AND subject < 0.15 THEN 1 ELSE 0 END) ELSE 0 END, 6) AS term,
    round(3 * greatest(clip_high - 0.02, 0) + 2 * greatest(clip_low - 0.10, 0), 6) AS penalty FROM u""",
)
def subject_term(spark, sf):
    rows = photos(spark, sf, "subject", "edge", "clip_high", "clip_low")
    return rows.select("photo_id", r6(sc.subject_term(F.col("subject"), F.col("edge")), "term"), r6(sc.exposure_penalty(F.col("clip_high"), F.col("clip_low")), "penalty"))


# the tables hold no boxes: they follow from the photo's number
_BOX_SQL = "(photo_id * 7 % 60) / 100.0 AS x1, (photo_id * 11 % 50) / 100.0 AS y1, (photo_id * 7 % 60 + photo_id % 43) / 100.0 AS x2, (photo_id * 11 % 50 + photo_id % 57) / 100.0 AS y2"


def _boxed(spark, sf):
    i = F.col("photo_id")
    corner = lambda a, b, c=None: (i * a % b + (i % c if c else 0)) / 100
    return photos(spark, sf).select("photo_id", corner(7, 60).alias("x1"), corner(11, 50).alias("y1"), corner(7, 60, 43).alias("x2"), corner(11, 50, 57).alias("y2"))


def _line(line: float) -> str:
    bell = lambda c: f"exp(-0.5 * pow(least(abs({c} - {line!r}), abs({c} - {1 - line!r})) / 0.08, 2))"
    return f"(greatest({bell('x')}, {bell('y')}) + sqrt({bell('x')} * {bell('y')})) / 2"


@SCORING.add(
    "composition_score",
    U[:-1] + f""", b AS (SELECT photo_id, {_BOX_SQL} FROM u), c AS (SELECT *, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, x2 > x1 AND y2 > y1 AND x2 <= 1 AND y2 <= 1 AS ok FROM b),
d AS (SELECT *, {_line(1 / 3)} AS t, {_line(0.382)} AS g, exp(-0.5 * (pow((x - 0.5) / 0.08, 2) + pow((y - 0.5) / 0.16, 2))) AS m, least(greatest((1 - greatest(x2 - x1, y2 - y1)) / 0.4, 0), 1) AS r FROM c)
SELECT photo_id, round(CASE WHEN ok THEN t END, 6) AS thirds, round(CASE WHEN ok THEN g END, 6) AS golden, round(CASE WHEN ok THEN m END, 6) AS centre,
round(CASE WHEN ok THEN r END, 6) AS reliability, round(CASE WHEN ok THEN r * greatest(t, g, m) END, 6) AS placement FROM d""",
)
def composition_score(spark, sf):
    parts = sc.placement(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    return _boxed(spark, sf).select("photo_id", *[r6(c, n) for n, c in parts.items()])


@SCORING.add(
    "surrounding_boxes",
    U[:-1] + f""", b AS (SELECT photo_id, {_BOX_SQL} FROM u), c AS (SELECT *, 1 - x2 AS p1, y1 AS q1, 1 - x1 AS p2, y2 AS q2, x2 > x1 AND y2 > y1 AND x2 <= 1 AND y2 <= 1 AS ok FROM b),
d AS (SELECT *, least(x1, p1) AS l, y1 AS t, greatest(x2, p2) AS r, y2 AS o FROM c)
SELECT photo_id, CASE WHEN NOT ok THEN 0 WHEN x1 = p1 AND x2 = p2 THEN 1 ELSE 2 END AS boxes, round(CASE WHEN ok THEN greatest(l - (r - l) * 0.25, 0) END, 6) AS left_edge,
round(CASE WHEN ok THEN least(o + (o - t) * 0.25, 1) END, 6) AS lower_edge FROM d""",
)
def surrounding_boxes(spark, sf):
    box = F.struct("x1", "y1", "x2", "y2").cast(sc.BOX)
    other = F.struct((1 - F.col("x2")).alias("x1"), F.col("y1"), (1 - F.col("x1")).alias("x2"), F.col("y2")).cast(sc.BOX)
    rows = _boxed(spark, sf).withColumn("boxes", sc.best_boxes(F.array(box, other)))
    around = sc.surrounding_box(F.col("boxes"))
    # two mirrored boxes are the same where rounding makes them so
    return rows.select("photo_id", F.when((F.size("boxes") == 2) & (F.col("x1") == 1 - F.col("x2")), 1).otherwise(F.size("boxes")).alias("boxes"), r6(around["x1"], "left_edge"), r6(around["y2"], "lower_edge"))


@SCORING.add(
    "edit_benefit",
    U[:-1] + """, e AS (SELECT photo_id, CAST(round_even(least(100, 45 * least(1, clip_high / 0.05) + 30 * least(1, clip_low / 0.15)
  + CASE WHEN photo_id % 255 < 80 THEN 15 * least(1, (80 - photo_id % 255) / 40.0) WHEN photo_id % 255 > 175 THEN 10 * least(1, (photo_id % 255 - 175) / 40.0) ELSE 0 END
  + coalesce(20 * least(1, greatest(0, (iso - 1600) / 6400.0)), 0)), 0) AS INT) AS benefit FROM u)
SELECT photo_id, benefit, CASE WHEN benefit >= 50 THEN 'high' WHEN benefit >= 25 THEN 'medium' ELSE 'low' END AS band FROM e""",
)
def edit_benefit(spark, sf):
    rows = photos(spark, sf, "clip_high", "clip_low", "iso")
    mean = (F.col("photo_id") % 255).cast("double")
    rows = rows.withColumn("benefit", sc.edit_benefit(F.col("clip_high"), F.col("clip_low"), mean, None, F.col("iso")))
    return rows.select("photo_id", "benefit", sc.band(F.col("benefit")).alias("band"))


@SCORING.add(
    "pick_budget",
    U[:-1] + """, g AS (SELECT shoot, label, count(*) AS n, least(5 + count(*) // 40, 15) AS budget FROM u GROUP BY 1, 2)
SELECT *, CAST(greatest(12, round_even(3.0 * budget, 0), ceil(0.5 * n)) AS BIGINT) AS cap FROM g""",
)
def pick_budget(spark, sf):
    g = photos(spark, sf, "shoot", "label").groupBy("shoot", "label").agg(F.count("*").alias("n")).withColumn("budget", sc.pick_budget(F.col("n")))
    return g.withColumn("cap", sc.shortlist_cap(F.col("n"), F.col("budget")))


@SCORING.add(
    "person_override",
    U[:-1] + """, o AS (SELECT photo_id, label, label_prob, person, coalesce(person, 0) >= 0.02 AND (label_prob IS NULL OR label_prob >= 0.2 OR person >= 0.5) AS hit FROM u)
SELECT photo_id, CASE WHEN hit THEN 'people' ELSE label END AS label, CASE WHEN hit THEN greatest(label_prob, person) ELSE label_prob END AS prob FROM o""",
)
def person_override(spark, sf):
    rows = photos(spark, sf, "label", "label_prob", "person")
    label, prob = scoring.person_override(F.col("label"), F.col("label_prob"), F.col("person"))
    return rows.select("photo_id", label.alias("label"), prob.alias("prob"))


@SCORING.add(
    "upright_crops",
    U[:-1] + """, a AS (SELECT photo_id, photo_id * 37 % 3600 / 10.0 AS angle FROM u), q AS (SELECT *, round_even(angle / 90, 0) * 90 AS quarter FROM a),
c AS (SELECT *, CASE WHEN photo_id % 5 = 0 THEN 0 WHEN photo_id % 3 = 0 OR abs(angle - quarter) < 2 THEN quarter % 360 ELSE angle END AS fix FROM q),
t AS (SELECT *, round_even(fix / 90, 0) AS turns, radians(abs(fix - round_even(fix / 90, 0) * 90)) AS tilt FROM c),
w AS (SELECT *, CASE WHEN turns % 2 = 1 THEN 800.0 ELSE 1200.0 END AS w, CASE WHEN turns % 2 = 1 THEN 1200.0 ELSE 800.0 END AS h FROM t),
s AS (SELECT *, least((w - 4) / (w * cos(tilt) + h * sin(tilt)), (h - 4) / (w * sin(tilt) + h * cos(tilt))) AS k FROM w)
SELECT photo_id, fix AS correction, CASE WHEN photo_id % 5 = 0 THEN 'abstained' WHEN fix <> 0 THEN 'corrected' ELSE 'upright' END AS status,
CAST(CASE WHEN tilt = 0 THEN w ELSE floor(w * k) END AS BIGINT) AS crop_width, CAST(CASE WHEN tilt = 0 THEN h ELSE floor(h * k) END AS BIGINT) AS crop_height FROM s""",
)
def upright_crops(spark, sf):
    i = F.col("photo_id")
    rows = photos(spark, sf).withColumn("angle", i * 37 % 3600 / 10.0)
    u = sc.upright(F.col("angle"), F.lit(1.0), i % 5 == 0, i % 3 == 0)
    rows = rows.select("photo_id", u["correction"].alias("correction"), u["status"].alias("status"))
    crop = sc.inscribed_crop(F.lit(1200.0), F.lit(800.0), F.col("correction"))
    return rows.select("photo_id", "correction", "status", *[c.alias(n) for n, c in crop.items()])


@SCORING.add(
    "midrank_score",
    U[:-1] + """, r AS (SELECT photo_id, shoot, aesthetic, rank() OVER w - 1 + (count(*) OVER (PARTITION BY shoot, aesthetic) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY shoot) AS n
FROM u WHERE aesthetic IS NOT NULL WINDOW w AS (PARTITION BY shoot ORDER BY aesthetic)) SELECT photo_id, round(CASE WHEN n > 1 THEN 2 * r / (n - 1) - 1 ELSE 0 END, 6) AS mid_rank FROM r""",
)
def midrank_score(spark, sf):
    rows = photos(spark, sf, "shoot", "aesthetic").where("aesthetic IS NOT NULL")
    return scoring.mid_rank(rows, ["shoot"], "aesthetic").select("photo_id", r6("mid_rank"))


@SCORING.add(
    "robust_quality",
    U[:-1] + """, m AS (SELECT photo_id, shoot, aesthetic, median(aesthetic) OVER (PARTITION BY shoot) AS med FROM u WHERE aesthetic IS NOT NULL),
d AS (SELECT *, median(abs(aesthetic - med)) OVER (PARTITION BY shoot) AS mad FROM m)
SELECT photo_id, round(1 / (1 + exp(-least(greatest((aesthetic - med) / greatest(1.4826 * mad, 1), -30), 30))), 6) AS quality FROM d""",
)
def robust_quality(spark, sf):
    rows = photos(spark, sf, "shoot", "aesthetic").where("aesthetic IS NOT NULL")
    return scoring.robust_quality(rows, ["shoot"], "aesthetic").select("photo_id", r6("quality"))


# ---- labels ------------------------------------------------------------------------------------------------------------------------

_FINITE = "len(dino) = 64 AND len(list_filter(dino, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(dino, lambda x: x <> 0)) > 0"
def _ip(a: str, b: str) -> str:
    """Inner product in DuckDB, whose own function rejects NULL lists next to others."""
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"


_UNIT = f", g AS (SELECT photo_id, shoot, label, camera, time, scene, burst, CASE WHEN {_FINITE} THEN list_transform(dino, lambda x: coalesce(CAST(x AS DOUBLE), 0)) END AS v FROM u), " + """
n AS (SELECT *, sqrt(""" + _ip("v", "v") + """) AS len FROM g), d AS (SELECT * EXCLUDE (v, len), list_transform(v, lambda x: x / len) AS v FROM n) """
_PROTO = """, e AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM d WHERE v IS NOT NULL AND label IS NOT NULL),
p AS (SELECT label, i, avg(x) AS x FROM e GROUP BY 1, 2), q AS (SELECT label, list(x ORDER BY i) AS m FROM p GROUP BY 1), proto AS (SELECT label, list_transform(m, lambda x: x / (sqrt(list_sum(list_transform(m, lambda y: y * y))) + 1e-9)) AS m FROM q)
"""


def _unit_photos(spark, sf, *columns):
    rows = photos(spark, sf, "dino", *columns)
    return vectors.with_unit(rows, "dino", "v", 64).drop("dino")


def _prototypes(spark, sf):
    rows = _unit_photos(spark, sf, "label").where("label IS NOT NULL")
    return vectors.mean_vector(rows, ["label"], "v", 64)


@SCORING.add("label_prototypes", U[:-1] + _UNIT + _PROTO + "SELECT label, i, round(x, 6) AS x FROM (SELECT label, unnest(m) AS x, generate_subscripts(m, 1) AS i FROM proto)")
def label_prototypes(spark, sf):
    return _prototypes(spark, sf).select("label", F.posexplode("mean").alias("i", "x")).select("label", (F.col("i") + 1).cast("long").alias("i"), r6("x"))


@SCORING.add(
    "zero_shot_argmax",
    U[:-1] + _UNIT + _PROTO + """, l AS (SELECT s.idx, s.label, s.is_people, m FROM subject_labels s JOIN proto USING (label)),
c AS (SELECT photo_id, idx, l.label, is_people, """ + _ip("v", "m") + """ AS s FROM d, l WHERE v IS NOT NULL), w AS (SELECT *, exp(100 * (s - max(s) OVER (PARTITION BY photo_id))) AS w FROM c)
SELECT photo_id, arg_max(label, {'s': s, 'i': -idx}) AS label, round(arg_max(w, {'s': s, 'i': -idx}) / sum(w), 4) AS label_prob, round(sum(CASE WHEN is_people THEN w ELSE 0 END) / sum(w), 4) AS people_prob FROM w GROUP BY 1""",
)
def zero_shot_argmax(spark, sf):
    labels = table(spark, sf, "subject_labels").join(_prototypes(spark, sf), "label")
    out = similarity.classify(_unit_photos(spark, sf), "photo_id", "v", labels, "mean")
    return out.select("photo_id", "label", F.round("label_prob", 4).alias("label_prob"), F.round("people_prob", 4).alias("people_prob"))


@SCORING.add(
    "reference_bonus",
    U[:-1] + _UNIT + """, f AS (SELECT v AS f FROM d WHERE v IS NOT NULL ORDER BY photo_id LIMIT 20), b AS (SELECT photo_id, max(""" + _ip("v", "f") + """) AS best FROM d LEFT JOIN f ON true GROUP BY 1)
SELECT photo_id, round(best, 6) AS best, round(coalesce(0.5 * least(greatest((best - 0.6) / (0.9 - 0.6), 0), 1), 0), 6) AS bonus FROM b""",
)
def reference_bonus(spark, sf):
    rows = _unit_photos(spark, sf)
    # the stated reference set: the first twenty photos with a vector
    chosen = [r["v"] for r in rows.where("v IS NOT NULL").orderBy("photo_id").limit(20).collect()]
    return similarity.reference_bonus(rows, "photo_id", "v", np.array(chosen)).select("photo_id", r6("best"), r6("bonus"))


# ---- sequences --------------------------------------------------------------------------------------------------------------------

_ORDERED = ", o AS (SELECT *, epoch_us(time) / 1e6 AS t, row_number() OVER (PARTITION BY camera ORDER BY time NULLS LAST, photo_id) AS rn FROM d WHERE camera IS NOT NULL)"
_DOT = f"{_ip('o.v', 'f.c')} / sqrt({_ip('f.c', 'f.c')})"
_ADD = "CASE WHEN o.v IS NULL THEN {old} WHEN {old} IS NULL THEN o.v ELSE list_transform(list_zip({old}, o.v), lambda p: p[1] + p[2]) END"


def _fold_sql(broken: str, last: str) -> str:
    return f"""SELECT o.camera, o.rn, o.photo_id, f.sid + CASE WHEN {broken} THEN 1 ELSE 0 END, {last},
      CASE WHEN {broken} THEN o.v ELSE {_ADD.format(old='f.c')} END"""


@SCORING.add(
    "scene_centroid_fold",
    "WITH RECURSIVE " + U[5:-1] + _UNIT + _ORDERED + """, f(camera, rn, photo_id, sid, last_t, c) AS (SELECT camera, rn, photo_id, 0, t, v FROM o WHERE rn = 1 UNION ALL """
    + _fold_sql(f"coalesce(o.t - f.last_t > 120, false) OR coalesce({_DOT} < 0.5, false)", "coalesce(o.t, f.last_t)")
    + " FROM f JOIN o ON o.camera = f.camera AND o.rn = f.rn + 1) SELECT photo_id, camera, sid AS scene_id FROM f",
)
def scene_centroid_fold(spark, sf):
    rows = _unit_photos(spark, sf, "camera", "time")
    return sequence.cluster_scenes(rows, "camera", "time", "v", ["photo_id"], 120.0, 0.5).select("photo_id", "camera", "scene_id")


_BY_DAY = _ORDERED.replace("PARTITION BY camera", "PARTITION BY day").replace(" WHERE camera IS NOT NULL", "").replace("photo_id) AS rn", "path, photo_id) AS rn")


@SCORING.add(
    "labelled_scenes",
    "WITH RECURSIVE " + U[5:-1] + _UNIT.replace("SELECT photo_id, shoot,", "SELECT photo_id, shoot, path, person, strftime(coalesce(time, TIMESTAMP '1900-01-01'), '%Y-%m-%d') AS day,") + _PROTO + _BY_DAY
    + """, f(day, rn, photo_id, sid, last_t, c) AS (SELECT day, rn, photo_id, 0, t, v FROM o WHERE rn = 1 UNION ALL """
    + _fold_sql(f"coalesce(o.t - f.last_t > 120, false) OR coalesce({_DOT} < 0.5, false)", "coalesce(o.t, f.last_t)").replace("o.camera", "o.day")
    + """ FROM f JOIN o ON o.day = f.day AND o.rn = f.rn + 1),
dn AS (SELECT replace(day, '1900-01-01', 'unknown-date') AS dk, day, max(sid) + 1 AS n FROM f GROUP BY 1, 2), off AS (SELECT day, coalesce(sum(n) OVER (ORDER BY dk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM dn),
sc AS (SELECT f.photo_id, CAST(f.sid + off.b AS INT) AS scene_id FROM f JOIN off USING (day)),
sv AS (SELECT scene_id, unnest(d.v) AS x, generate_subscripts(d.v, 1) AS i FROM sc JOIN d USING (photo_id) WHERE d.v IS NOT NULL), sa AS (SELECT scene_id, i, avg(x) AS x FROM sv GROUP BY 1, 2),
sm0 AS (SELECT scene_id, list(x ORDER BY i) AS m FROM sa GROUP BY 1), sm AS (SELECT scene_id, list_transform(m, lambda x: x / (sqrt(list_sum(list_transform(m, lambda y: y * y))) + 1e-9)) AS v FROM sm0),
l AS (SELECT s.idx, s.label, m FROM subject_labels s JOIN proto USING (label)), cc AS (SELECT scene_id, idx, label, """ + _ip("v", "m") + """ AS s FROM sm, l),
w AS (SELECT *, exp(100 * (s - max(s) OVER (PARTITION BY scene_id))) AS w FROM cc), best AS (SELECT scene_id, arg_max(label, {'s': s, 'i': -idx}) AS label, arg_max(w, {'s': s, 'i': -idx}) / sum(w) AS prob FROM w GROUP BY 1),
j AS (SELECT sc.photo_id, sc.scene_id, best.label, best.prob, d.person FROM sc JOIN d USING (photo_id) LEFT JOIN best USING (scene_id)),
h AS (SELECT *, coalesce(person, 0) >= 0.02 AND (prob IS NULL OR prob >= 0.2 OR person >= 0.5) AS hit FROM j)
SELECT photo_id, scene_id, CASE WHEN hit THEN 'people' ELSE label END AS label, round(CASE WHEN hit THEN greatest(prob, person) ELSE prob END, 4) AS prob FROM h""",
)
def labelled_scenes(spark, sf):
    """Scenes of each day in order of time and name, numbered through all days, with one label each by the mean of their vectors; photos in
    which a person stands out are labelled by that, whatever their scene."""
    rows = _unit_photos(spark, sf, "time", "day", "path", "person")
    cut = materialize(sequence.global_ids(sequence.cluster_scenes(rows, "day", "time", "v", ["path", "photo_id"], 120.0, 0.5), "day", "scene_id"), "scenes")
    labels = table(spark, sf, "subject_labels").join(_prototypes(spark, sf), "label")
    means = vectors.mean_vector(cut.select("scene_id", "v"), ["scene_id"], "v", 64)
    told = similarity.classify(means, "scene_id", "mean", labels, "mean").select("scene_id", "label", "label_prob")
    label, prob = scoring.person_override(F.col("label"), F.col("label_prob"), F.col("person"))
    return cut.join(told, "scene_id", "left").select("photo_id", "scene_id", label.alias("label"), F.round(prob, 4).alias("prob"))


@SCORING.add(
    "moment_fold",
    "WITH RECURSIVE " + U[5:-1] + _UNIT + _ORDERED + """, f(camera, rn, photo_id, sid, last_t, c, sc) AS (SELECT camera, rn, photo_id, 0, t, v, scene FROM o WHERE rn = 1 UNION ALL """
    + _fold_sql(f"coalesce(o.t - f.last_t > 8, false) OR o.scene <> f.sc OR coalesce({_DOT} < 0.8, false)", "o.t") + ", o.scene"
    + " FROM f JOIN o ON o.camera = f.camera AND o.rn = f.rn + 1) SELECT photo_id, camera, sid AS moment_id FROM f",
)
def moment_fold(spark, sf):
    rows = _unit_photos(spark, sf, "camera", "time", "scene")
    return sequence.cluster_moments(rows, "camera", "time", "scene", "v", None, ["photo_id"], 8.0, 0.8).select("photo_id", "camera", "moment_id")


@SCORING.add(
    "burst_fold",
    "WITH RECURSIVE " + U[5:-1] + _UNIT + _ORDERED + """, f(camera, rn, photo_id, sid, last_t, began, c, sc) AS (
SELECT camera, rn, photo_id, CASE WHEN t IS NULL THEN -1 ELSE 0 END, t, t, v, scene FROM o WHERE rn = 1 UNION ALL
SELECT camera, rn, photo_id, CASE WHEN t IS NULL THEN sid WHEN brk THEN sid + 1 ELSE sid END, t, CASE WHEN brk THEN t ELSE began END, CASE WHEN brk THEN v ELSE added END, scene FROM (
  SELECT o.camera, o.rn, o.photo_id, o.t, o.v, o.scene, f.sid, f.began, """ + _ADD.format(old="f.c") + f""" AS added,
    o.t IS NOT NULL AND (f.last_t IS NULL OR o.t < f.last_t OR o.t - f.last_t > 3 OR o.t - f.began >= 12 OR o.scene <> f.sc OR coalesce({_DOT} < 0.6, false)) AS brk
  FROM f JOIN o ON o.camera = f.camera AND o.rn = f.rn + 1))
SELECT photo_id, camera, CASE WHEN last_t IS NULL THEN -1 ELSE sid END AS burst_id FROM f""",
)
def burst_fold(spark, sf):
    rows = _unit_photos(spark, sf, "camera", "time", "scene")
    return sequence.cluster_bursts(rows, "camera", "time", "scene", "v", ["photo_id"], 3.0, 12.0, 0.6).select("photo_id", "camera", "burst_id")


# ---- texts -------------------------------------------------------------------------------------------------------------------------


@SCORING.add(
    "path_parts",
    U + r"""SELECT photo_id, regexp_extract(path, '([^/]*)$', 1) AS name, lower(regexp_extract(path, '(\.[^./]*)$', 1)) AS ext, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '') AS stem,
    regexp_replace(path, '/?[^/]*$', '') AS parent FROM u""",
)
def path_parts(spark, sf):
    p = F.col("path")
    return photos(spark, sf, "path").select("photo_id", texts.base_name(p).alias("name"), texts.suffix(p).alias("ext"), texts.stem(p).alias("stem"), texts.parent(p).alias("parent"))


@SCORING.add(
    "folded_texts",
    r"""SELECT doc_id, trim(regexp_replace(lower(text), '[ \t\n\r\f\v]+', ' ', 'g')) AS folded, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped,
    sha256(source || chr(0) || text) AS item_id FROM documents""",
)
def folded_texts(spark, sf):
    d = table(spark, sf, "documents")
    t = F.col("text")
    return d.select("doc_id", texts.folded(t).alias("folded"), texts.xml_escaped(t).alias("escaped"), texts.item_id(F.col("source"), t).alias("item_id"))
