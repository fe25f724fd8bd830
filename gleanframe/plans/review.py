"""Queries on decisions, evaluation, file matching and reports. The votes of the tables stand for human decisions on the selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanframe.functions import texts
from gleanframe.operators import decisions, evaluation, reporting, selection
from gleanframe.operators.ranks import numbered
from gleanframe.plans.registry import Registry, table
from gleanframe.plans.selection import C, candidates
from gleanframe.sources import features, files

REVIEW = Registry()

# every vote keeps its winner and, where the note is not empty, rejects its loser; each shoot's selection is its best scores
V = """v AS (SELECT DISTINCT seq, shoot, winner, loser, note, updated_at FROM preferences),
log AS (SELECT seq * 2 AS revision, winner AS id, 'keep' AS choice, note FROM v WHERE winner IS NOT NULL UNION ALL SELECT seq * 2 + 1, loser, 'reject', note FROM v WHERE loser IS NOT NULL AND note <> ''),
state AS (SELECT id, max(revision) AS revision, arg_max(choice, revision) AS choice, arg_max(note, revision) AS note FROM log GROUP BY 1)
"""
P = "WITH p AS (SELECT DISTINCT path AS id, shoot, moment, scene, reject, aesthetic, label, coalesce(strftime(time, '%Y-%m-%d'), 'unknown-date') AS day, row_number() OVER (PARTITION BY shoot ORDER BY aesthetic DESC NULLS LAST, path) AS place FROM (SELECT DISTINCT ON (photo_id) * FROM photos ORDER BY photo_id)), "
SEL = P + "sel AS (SELECT p.*, CASE WHEN reject = 'exposure' THEN NULL ELSE place <= s.keepers END AS picked FROM p JOIN shoots s USING (shoot)), " + V


def votes(spark, sf):
    return table(spark, sf, "preferences").select("seq", "shoot", "winner", "loser", "note", "updated_at").distinct()


def log(spark, sf):
    v = votes(spark, sf)
    keep = v.where("winner IS NOT NULL").select((F.col("seq") * 2).alias("revision"), F.col("winner").alias("item_id"), F.lit("keep").alias("choice"), "note")
    drop = v.where("loser IS NOT NULL AND note <> ''").select((F.col("seq") * 2 + 1).alias("revision"), F.col("loser").alias("item_id"), F.lit("reject").alias("choice"), "note")
    return keep.unionByName(drop).withColumn("relative", F.col("item_id")).withColumn("origin", F.lit("vote"))


def selections(spark, sf, every_place=False):
    """Photos with their day, the keepers of their shoot, their place in the shoot by score and whether they are picked.

    Places are known as far as a pick or a report needs them, which Spark prunes in every partition; with ``every_place`` of all photos, by
    one range-ordered sort.
    """
    from pyspark.sql import Window

    p = table(spark, sf, "photos").select("photo_id", F.col("path").alias("id"), "shoot", "moment", "scene", "reject", "aesthetic", "label", "time").dropDuplicates(["photo_id"])
    p = p.withColumn("day", F.coalesce(F.date_format("time", "yyyy-MM-dd"), F.lit("unknown-date")))
    shoots = table(spark, sf, "shoots").select("shoot", "keepers", "split_name")
    order = [F.desc_nulls_last("aesthetic"), F.col("id")]
    if every_place:
        p = numbered(p.join(shoots, "shoot"), ["shoot"], order)
    else:
        most = max(30, 2 * (shoots.agg(F.max("keepers")).first()[0] or 0))
        lean = table(spark, sf, "photos").select("photo_id", F.col("path").alias("id"), "shoot", "aesthetic").dropDuplicates(["photo_id"])
        head = lean.withColumn("place", F.row_number().over(Window.partitionBy("shoot").orderBy(*order))).where(F.col("place") <= most)
        p = p.join(head.select("photo_id", "place"), "photo_id", "left").join(shoots, "shoot")
    return p.withColumn("picked", F.when(F.col("reject") == "exposure", None).otherwise(F.coalesce(F.col("place") <= F.col("keepers"), F.lit(False))))


@REVIEW.add("latest_decisions", "WITH " + V + "SELECT id AS item_id, revision, choice, note FROM state")
def latest_decisions(spark, sf):
    return decisions.decisions_at(log(spark, sf)).select("item_id", "revision", "choice", "note")


@REVIEW.add(
    "decision_overlay",
    SEL + """SELECT s.id AS item_id, coalesce(CASE choice WHEN 'keep' THEN true WHEN 'reject' THEN false END, picked) AS selected, coalesce(choice, '') AS manual_decision,
CASE WHEN choice IS NULL THEN '' WHEN note <> '' THEN 'Manual ' || choice || ': ' || note ELSE 'Manual ' || choice END AS manual_reason, CASE WHEN choice IS NOT NULL THEN 'applied' ELSE '' END AS status
FROM sel s LEFT JOIN state t ON s.id = t.id""",
)
def decision_overlay(spark, sf):
    rows = selections(spark, sf).select(F.col("id").alias("item_id"), F.col("id").alias("relative"), F.col("picked").alias("auto_selected"))
    return decisions.overlay(rows, decisions.decisions_at(log(spark, sf))).select("item_id", "selected", "manual_decision", "manual_reason", "status")


_LAST = "lastv AS (SELECT shoot, least(winner, loser) AS a, greatest(winner, loser) AS b, arg_max(winner, {'s': seq, 'w': winner}) AS winner, arg_max(loser, {'s': seq, 'w': winner}) AS loser FROM v WHERE winner IS NOT NULL AND loser IS NOT NULL AND winner <> loser GROUP BY 1, 2, 3)"


@REVIEW.add("latest_preference", "WITH " + V + ", " + _LAST + " SELECT shoot, winner, loser FROM lastv")
def latest_preference(spark, sf):
    return decisions.latest_preferences(votes(spark, sf), ["shoot"], "winner", "loser", "seq").select("shoot", "winner", "loser")


@REVIEW.add(
    "pairwise_outcomes",
    SEL + ", " + _LAST + """ SELECT l.shoot, CASE WHEN a.picked IS NULL OR b.picked IS NULL THEN 'unknown' WHEN a.picked AND b.picked THEN 'both' WHEN a.picked THEN 'preferred_only' WHEN b.picked THEN 'other_only' ELSE 'neither' END AS outcome, count(*) AS pairs
FROM lastv l LEFT JOIN sel a ON a.id = l.winner AND a.shoot = l.shoot LEFT JOIN sel b ON b.id = l.loser AND b.shoot = l.shoot GROUP BY 1, 2""",
)
def pairwise_outcomes(spark, sf):
    last = decisions.latest_preferences(votes(spark, sf), ["shoot"], "winner", "loser", "seq")
    out = evaluation.pair_outcomes(last, selections(spark, sf), ["shoot"], "id", "picked")
    return out.groupBy("shoot", "outcome").agg(F.count("*").alias("pairs"))


_GROUPS = ", g AS (SELECT s.shoot, split_name, moment, bool_or(picked) AS hit, count(*) FILTER (picked IS NULL) AS open, count(*) FILTER (picked) AS n FROM sel s JOIN shoots USING (shoot) GROUP BY 1, 2, 3), w AS (SELECT *, CASE WHEN coalesce(hit, false) THEN true WHEN open > 0 THEN NULL ELSE false END AS verdict FROM g)"
_COUNT = "count(*) FILTER (verdict) AS hits, count(verdict) AS total, count(*) FILTER (verdict IS NULL) AS unknown, CASE WHEN count(verdict) > 0 AND count(*) = count(verdict) THEN count(*) FILTER (verdict) / count(verdict) END AS recall, count(*) FILTER (verdict) / count(*) AS recall_lower, (count(*) FILTER (verdict) + count(*) FILTER (verdict IS NULL)) / count(*) AS recall_upper"


def _moments(spark, sf):
    return evaluation.group_verdicts(selections(spark, sf), ["shoot", "split_name", "moment"], "picked")


@REVIEW.add("recall_moments", SEL + _GROUPS + f" SELECT shoot, split_name, {_COUNT} FROM w GROUP BY 1, 2")
def recall_moments(spark, sf):
    return evaluation.recall_counts(_moments(spark, sf), ["shoot", "split_name"])


@REVIEW.add("recall_by_split", SEL + _GROUPS + f" SELECT split_name, {_COUNT} FROM w GROUP BY 1")
def recall_by_split(spark, sf):
    return evaluation.add_up(evaluation.recall_counts(_moments(spark, sf), ["shoot", "split_name"]), ["split_name"])


@REVIEW.add("redundant_picks", SEL + _GROUPS + " SELECT shoot, CAST(sum(greatest(n - 1, 0)) AS BIGINT) AS excess, count(*) FILTER (open = 0) AS fully_evaluated FROM w GROUP BY 1")
def redundant_picks(spark, sf):
    return evaluation.redundant(selections(spark, sf), ["shoot"], ["moment"], "picked")


@REVIEW.add(
    "recall_delta",
    SEL + """, f AS (SELECT DISTINCT shoot, winner AS id FROM v WHERE winner IS NOT NULL), a AS (SELECT s.shoot, s.id, s.picked, s.place <= 2 * h.keepers AS wide FROM sel s JOIN shoots h USING (shoot) JOIN f ON f.id = s.id AND f.shoot = s.shoot),
c AS (SELECT shoot, count(*) FILTER (picked) AS h, count(picked) AS t, count(*) FILTER (picked IS NULL) AS o, count(*) FILTER (wide) AS h2, count(*) AS t2 FROM a GROUP BY 1)
SELECT shoot, CASE WHEN o = 0 AND t = t2 AND t > 0 THEN h2 / t2 - h / t END AS recall_delta FROM c""",
)
def recall_delta(spark, sf):
    fav = votes(spark, sf).where("winner IS NOT NULL").select("shoot", F.col("winner").alias("id")).distinct()
    rows = selections(spark, sf).join(fav, ["shoot", "id"], "left_semi")
    narrow = evaluation.recall_counts(rows, ["shoot"], "picked")
    wide = evaluation.recall_counts(rows.withColumn("wide", F.coalesce(F.col("place") <= 2 * F.col("keepers"), F.lit(False))), ["shoot"], "wide")
    return evaluation.delta(wide, narrow, ["shoot"])


@REVIEW.add(
    "corrections",
    SEL + """, f AS (SELECT DISTINCT shoot, winner AS id FROM v WHERE winner IS NOT NULL), r AS (SELECT DISTINCT shoot, loser AS id FROM v WHERE loser IS NOT NULL AND note <> '')
SELECT s.shoot, s.id, 'add' AS action FROM sel s JOIN f ON f.id = s.id AND f.shoot = s.shoot WHERE NOT picked UNION ALL SELECT s.shoot, s.id, 'remove' FROM sel s JOIN r ON r.id = s.id AND r.shoot = s.shoot WHERE picked""",
)
def corrections(spark, sf):
    v = votes(spark, sf)
    fav = v.where("winner IS NOT NULL").select("shoot", F.col("winner").alias("id"))
    bad = v.where("loser IS NOT NULL AND note <> ''").select("shoot", F.col("loser").alias("id"))
    return evaluation.corrections(selections(spark, sf), fav, bad, ["shoot"], "id", "picked")


@REVIEW.add(
    "moved_decisions",
    C + """, u AS (SELECT digest, min(id) AS id, min(CASE WHEN coalesce(score, 0) > 0 THEN 'keep' ELSE 'reject' END) AS choice FROM c WHERE digest <> '' GROUP BY 1 HAVING count(*) = 1)
SELECT 'old/' || id AS old_relative, id AS new_relative, digest, choice FROM u""",
)
def moved_decisions(spark, sf):
    """Every candidate was decided under another folder; the decisions follow their content where it is unique."""
    rows = candidates(spark, sf, "digest", "score").select(F.col("id").alias("relative"), "digest", F.when(F.coalesce("score", F.lit(0.0)) > 0, "keep").otherwise("reject").alias("choice"))
    decided = rows.withColumn("relative", F.concat(F.lit("old/"), "relative"))
    return decisions.moved(decided, rows.drop("choice"))


@REVIEW.add(
    "incremental_todo",
    "SELECT DISTINCT p.path AS path, 'new' AS reason FROM photos p WHERE p.path IS NOT NULL AND p.path NOT IN (SELECT id FROM candidates) UNION ALL SELECT DISTINCT c.id, 'digest' FROM candidates c WHERE nullif(c.digest, '') IS NULL AND c.id IN (SELECT path FROM photos)",
)
def incremental_todo(spark, sf):
    items = table(spark, sf, "photos").select("path").distinct()
    have = candidates(spark, sf, "digest").select(F.col("id").alias("path"), F.nullif("digest", F.lit("")).alias("digest"))
    return features.todo(items, have, "path", ["digest"])


@REVIEW.add(
    "raw_suppression",
    r"""WITH f AS (SELECT DISTINCT path, lower(regexp_extract(path, '(\.[^./]*)$', 1)) AS ext, lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '')) AS stem, regexp_replace(path, '/?[^/]*$', '') AS parent FROM photos),
j AS (SELECT DISTINCT parent, stem FROM f WHERE ext IN ('.jpg', '.jpeg', '.jpe')) SELECT path FROM f WHERE ext IN ('.jpg', '.jpeg', '.jpe') OR (ext IN ('.orf', '.cr2', '.cr3', '.nef', '.arw', '.dng', '.raf', '.rw2', '.pef', '.srw', '.raw', '.nrw')
AND NOT EXISTS (SELECT 1 FROM j WHERE j.parent = f.parent AND j.stem = f.stem))""",
)
def raw_suppression(spark, sf):
    p = F.col("path")
    listing = table(spark, sf, "photos").select("path").distinct()
    listing = listing.select("path", p.alias("relative"), texts.parent(p).alias("parent"), texts.base_name(p).alias("name"), texts.stem(p).alias("stem"), texts.suffix(p).alias("ext"))
    return files.images(listing).select("path")


@REVIEW.add("raw_cull_sets", SEL + r"""SELECT regexp_replace(id, '\.[^.]*$', '') AS raw, bool_or(coalesce(picked, false)) AS keep FROM sel GROUP BY 1""")
def raw_cull_sets(spark, sf):
    rows = selections(spark, sf).withColumn("raw", F.regexp_replace("id", r"\.[^.]*$", ""))
    return decisions.cull_sets(rows, "id", "raw", "picked")


@REVIEW.add("day_label_summary", SEL + "SELECT day, label, count(*) AS photos, count(*) FILTER (picked) AS picks FROM sel GROUP BY 1, 2")
def day_label_summary(spark, sf):
    return selections(spark, sf).groupBy("day", "label").agg(F.count("*").alias("photos"), F.count_if(F.coalesce("picked", F.lit(False))).alias("picks"))


@REVIEW.add("report_page", SEL + "SELECT day, label, id FROM sel WHERE picked ORDER BY day, label NULLS FIRST, id LIMIT 48 OFFSET 48")
def report_page(spark, sf):
    """The second page of 48 of the picks, in report order."""
    rows = selections(spark, sf).where("picked").select("day", "label", "id")
    return rows.orderBy("day", F.asc_nulls_first("label"), "id").offset(48).limit(48)


@REVIEW.add(
    "report_rows",
    SEL + "SELECT id AS file, coalesce(label, '') AS label, CASE WHEN aesthetic IS NULL THEN '' ELSE printf('%.2f', aesthetic) END AS aesthetic, CASE WHEN picked THEN '1' ELSE '0' END AS selected, coalesce(reject, '') AS reject FROM sel",
)
def report_rows(spark, sf):
    f = [("file", F.col("id")), ("label", F.col("label")), ("aesthetic", reporting.fixed(F.col("aesthetic"), 2)), ("selected", reporting.flag(F.col("picked"))), ("reject", F.col("reject"))]
    return reporting.report(selections(spark, sf), f, ["day", "label", "id"])


@REVIEW.add(
    "sidecar_ratings",
    SEL + "SELECT id, CASE WHEN coalesce(picked, false) THEN 5 WHEN reject <> '' THEN 1 WHEN place <= 30 THEN 3 ELSE 0 END AS rating, CASE WHEN label IS NULL THEN '' ELSE regexp_replace(label, '[^\\p{L}\\p{N} \\-_()]', '_', 'g') END AS folder FROM sel",
)
def sidecar_ratings(spark, sf):
    rows = selections(spark, sf)
    stars = reporting.rating(F.coalesce("picked", F.lit(False)), F.col("reject") != "", F.coalesce(F.col("place") <= 30, F.lit(False)))
    return rows.select("id", stars.alias("rating"), F.coalesce(reporting.folder("label", F.col("day"), F.col("label")), F.lit("")).alias("folder"))


@REVIEW.add(
    "unique_targets",
    SEL + r""", n AS (SELECT id, day, regexp_extract(id, '([^/]*)$', 1) AS name FROM sel), k AS (SELECT *, row_number() OVER (PARTITION BY day, lower(name) ORDER BY id) AS i FROM n)
SELECT id, CASE WHEN i = 1 THEN name ELSE regexp_replace(name, '\.[^.]*$', '') || '_' || i || regexp_extract(name, '(\.[^.]*)$', 1) END AS target FROM k""",
)
def unique_targets(spark, sf):
    rows = selections(spark, sf).select("id", "day", texts.base_name(F.col("id")).alias("name"))
    return reporting.unique_names(rows, ["day"], "name", [F.col("id")]).select("id", "target")


@REVIEW.add(
    "matched_reports",
    SEL + r""", r AS (SELECT id, CASE WHEN place % 3 = 0 THEN '/old/' || id WHEN place % 3 = 1 THEN id ELSE '/lost/' || regexp_extract(id, '([^/]*)$', 1) END AS file FROM sel), f AS (SELECT DISTINCT id AS path, regexp_extract(id, '([^/]*)$', 1) AS name FROM sel),
n AS (SELECT name, count(*) AS n, min(path) AS path FROM f GROUP BY 1), m AS (SELECT regexp_extract(file, '([^/]*)$', 1) AS name, count(*) AS n FROM r GROUP BY 1)
SELECT r.id, CASE WHEN f.path IS NOT NULL THEN 'path' WHEN n.n = 1 AND m.n = 1 THEN 'name' WHEN n.n IS NOT NULL THEN 'ambiguous' ELSE 'missing' END AS match, CASE WHEN f.path IS NOT NULL THEN f.path WHEN n.n = 1 AND m.n = 1 THEN n.path END AS found
FROM r LEFT JOIN f ON f.path = r.file LEFT JOIN n ON n.name = regexp_extract(r.file, '([^/]*)$', 1) LEFT JOIN m ON m.name = n.name""",
)
def matched_reports(spark, sf):
    rows = selections(spark, sf, every_place=True)
    name = texts.base_name(F.col("id"))
    file = F.when(F.col("place") % 3 == 0, F.concat(F.lit("/old/"), "id")).when(F.col("place") % 3 == 1, F.col("id")).otherwise(F.concat(F.lit("/lost/"), name))
    known = rows.select(F.col("id").alias("path"), F.concat(F.lit("x/"), "id").alias("relative"), name.alias("name")).distinct()
    return decisions.resolve(rows.select("id", file.alias("file"), F.lit(None).cast("string").alias("relative")), known).select("id", "match", "found")


@REVIEW.add(
    "parsed_replies",
    C + """, n AS (SELECT id, shoot, scene, count(*) OVER (PARTITION BY shoot, scene) AS n, row_number() OVER (PARTITION BY shoot, scene ORDER BY id) - 1 AS i FROM c WHERE id IS NOT NULL),
b AS (SELECT *, CAST(ceil(n / 12.0) AS BIGINT) AS m FROM n),
h AS (SELECT *, CAST(CASE WHEN i < (n % m) * (n // m + 1) THEN i // (n // m + 1) ELSE n % m + (i - (n % m) * (n // m + 1)) // (n // m) END AS INT) AS chunk FROM b)
SELECT shoot, scene, chunk, CAST(row_number() OVER (PARTITION BY shoot, scene, chunk ORDER BY id) - 1 AS INT) AS place, id FROM h""",
)
def parsed_replies(spark, sf):
    """Ranked replies written as JSON inside prose and read back: one row per pick, a scene's items in replies of at most 12 each."""
    rows = selection.balanced_chunks(candidates(spark, sf, "shoot", "scene").where("id IS NOT NULL"), ["shoot", "scene"], [F.col("id")], 12)
    groups = rows.groupBy("shoot", "scene", "chunk").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    picks = F.transform(F.sequence(F.lit(0), F.size("ids") + 1), lambda i: F.concat(F.lit('{"photo": '), i.cast("string"), F.lit(', "reason": "clear \\"eye\\""}')))
    reply = F.concat(F.lit('Here is my answer:\n{"picks": ['), F.array_join(picks, ", "), F.lit(', 1, "x"]}\nThanks.'))
    return groups.select("shoot", "scene", "chunk", F.posexplode(texts.ranked_picks(reply, F.col("ids"))).alias("place", "id"))


# ---- a run against what was declared: columns of the photos stand for the states of files and judgments ------------------------------------

_STATES = SEL + """, st AS (SELECT s.shoot, s.id, CASE WHEN s.time IS NULL THEN 'missing' WHEN s.label IS NULL THEN 'unverified' WHEN s.clip_high > 0.3 THEN 'changed' ELSE 'available' END AS source,
  CASE WHEN s.iso IS NULL THEN NULL WHEN s.iso >= 6400 THEN 'incomplete' ELSE 'complete' END AS judgment, s.reject <> 'blurry' AS here, CASE WHEN s.aesthetic IS NULL THEN '' WHEN s.place <= 2 * h.keepers THEN '1' ELSE '0' END AS shortlisted,
  s.place <= h.keepers AS auto, coalesce(s.person, 0) >= 0.5 AS inc, CASE WHEN s.iso IS NULL AND s.edge THEN true ELSE false END AS broke FROM sel s JOIN shoots h USING (shoot)),
rec AS (SELECT shoot, bool_or(shortlisted = '1') AS recorded FROM st WHERE here GROUP BY 1),
e AS (SELECT st.*, CASE WHEN NOT here THEN 'unevaluated' WHEN judgment IS NULL AND broke THEN 'failed' ELSE judgment END AS status, coalesce(recorded, false) AS recorded FROM st LEFT JOIN rec USING (shoot)),
v AS (SELECT *, CASE WHEN NOT here OR shortlisted = '' OR NOT recorded OR source IN ('missing', 'changed') OR status = 'unevaluated' THEN NULL ELSE shortlisted = '1' END AS was_shown,
  CASE WHEN NOT here OR inc OR source IN ('missing', 'changed') OR status IN ('unevaluated', 'incomplete', 'failed') THEN NULL ELSE auto END AS was_picked FROM e)
""".replace("FROM sel s JOIN shoots h USING (shoot)),", "FROM more s JOIN shoots h USING (shoot)),")
_STATES = _STATES.replace(", v AS (SELECT DISTINCT seq", ", vv AS (SELECT DISTINCT seq").replace("FROM v WHERE", "FROM vv WHERE")
_STATES = _STATES.replace(", st AS (SELECT s.shoot", ", more AS (SELECT sel.*, q.time, q.clip_high, q.iso, q.person, q.edge FROM sel JOIN (SELECT DISTINCT ON (photo_id) path, time, clip_high, iso, person, edge FROM photos ORDER BY photo_id) q ON q.path = sel.id), st AS (SELECT s.shoot", 1)


def _states(spark, sf):
    more = table(spark, sf, "photos").select("photo_id", F.col("time").alias("at"), "clip_high", "iso", "person", "edge").dropDuplicates(["photo_id"])
    s = selections(spark, sf).join(more, "photo_id")
    source = F.when(F.col("at").isNull(), "missing").when(F.col("label").isNull(), "unverified").when(F.col("clip_high") > 0.3, "changed").otherwise("available")
    judgment = F.when(F.col("iso") >= 6400, "incomplete").when(F.col("iso").isNotNull(), "complete")
    declared = s.select("shoot", "id", source.alias("source"), judgment.alias("judgment"))
    inside = lambda n: F.coalesce(F.col("place") <= n * F.col("keepers"), F.lit(False))
    forced = F.coalesce("person", F.lit(0.0)) >= 0.5
    reason = F.when(forced, "forced by --include").when(F.col("iso").isNull() & F.col("edge"), "(judge failed, by score)").otherwise("")
    rows = s.where("reject <> 'blurry'").select(
        "shoot", "id", F.when(F.col("aesthetic").isNull(), "").when(inside(2), "1").otherwise("0").alias("shortlisted"), reporting.flag(inside(1)).alias("selected"), reporting.flag(inside(1)).alias("auto_selected"),
        reason.alias("judge_reason"), F.when(forced, "Forced by --include").otherwise("").alias("auto_decision"), "reject",
    )
    return evaluation.judged_states(declared, rows, ["shoot"])


@REVIEW.add(
    "evaluation_coverage",
    _STATES + """SELECT shoot, count(*) AS eligible, count(*) FILTER (here) AS report_rows, count(*) FILTER (source = 'missing') AS missing_files, count(*) FILTER (source = 'changed') AS changed_files,
count(*) FILTER (source = 'unverified') AS files_unverified, count(*) FILTER (status = 'unevaluated') AS unevaluated, count(*) FILTER (status = 'incomplete') AS incomplete_judgments, count(*) FILTER (status = 'failed') AS failed_judgments,
count(*) FILTER (status IS NULL) AS unknown_judgments, count(*) FILTER (was_shown IS NULL) AS shortlist_unknown, count(*) FILTER (NOT was_shown) AS not_shortlisted, count(*) FILTER (inc AND here) AS human_forced,
count(*) FILTER (was_shown) AS candidates, count(*) FILTER (was_picked) AS picks FROM v GROUP BY 1""",
)
def evaluation_coverage(spark, sf):
    """The coverage counters of every shoot."""
    return evaluation.coverage(_states(spark, sf), ["shoot"])


@REVIEW.add(
    "evaluation_compare",
    SEL + """, a AS (SELECT s.shoot, s.id, place <= h.keepers AS narrow, place <= 2 * h.keepers AS wide, reject = 'exposure' AS open FROM sel s JOIN shoots h USING (shoot))
SELECT shoot, CASE WHEN count(*) FILTER (open) = 0 THEN count(*) FILTER (wide) / count(*) - count(*) FILTER (narrow) / count(*) END AS recall_delta, true AS verified FROM a GROUP BY 1""",
)
def evaluation_compare(spark, sf):
    """A wider selection against a narrower one over the same photos."""
    rows = selections(spark, sf)
    pick = lambda n: F.when(F.col("reject") == "exposure", None).otherwise(F.coalesce(F.col("place") <= n * F.col("keepers"), F.lit(False)))
    run = lambda n: rows.select("shoot", "id", pick(n).alias("picked"), F.sha2("id", 256).alias("digest"))
    return evaluation.comparison(run(1), run(2), ["shoot"], "id", "picked", "digest")


@REVIEW.add("feedback_export", "WITH " + V + "SELECT id AS item_id, CASE choice WHEN 'keep' THEN 'favourite' ELSE 'rejected' END AS kind FROM state")
def feedback_export(spark, sf):
    return evaluation.feedback(decisions.decisions_at(log(spark, sf)))


@REVIEW.add(
    "overlay_export",
    SEL + """, top AS (SELECT max(revision) AS r FROM state) SELECT s.id AS item_id, picked AS auto_selected, coalesce(CASE choice WHEN 'keep' THEN true WHEN 'reject' THEN false END, picked) AS selected, coalesce(choice, '') AS manual_decision,
CASE WHEN choice IS NOT NULL THEN 'Manual ' || choice || CASE WHEN note <> '' THEN ': ' || note ELSE '' END WHEN picked THEN 'Selected by score' ELSE '' END AS decision, CASE WHEN choice IS NOT NULL THEN 'applied' ELSE '' END AS review_status, top.r AS review_revision
FROM sel s LEFT JOIN state t ON s.id = t.id CROSS JOIN top""",
)
def overlay_export(spark, sf):
    state = decisions.decisions_at(log(spark, sf))
    top = state.agg(F.max("revision")).first()[0] or 0
    rows = selections(spark, sf).select(F.col("id").alias("item_id"), F.col("id").alias("relative"), F.col("picked").alias("auto_selected"), F.when(F.col("picked"), "Selected by score").otherwise("").alias("auto_decision"))
    return decisions.exported(rows, state, F.lit(top)).select("item_id", "auto_selected", "selected", "manual_decision", "decision", "review_status", "review_revision")


_REPORT_SQL = {
    "file": "s.id", "datetime": "coalesce(strftime(q.time, '%Y-%m-%dT%H:%M:%S'), '')", "day": "s.day", "label": "coalesce(s.label, '')", "label_prob": "q.label_prob:2", "person": "q.person:3", "subject": "q.subject:3",
    "edge": "CASE WHEN q.edge THEN '1' ELSE '0' END", "scene": "coalesce(CAST(s.scene AS VARCHAR), '')", "sharpness": "q.sharpness:1", "clip_low": "q.clip_low:3", "clip_high": "q.clip_high:3", "aesthetic": "s.aesthetic:2",
    "reject": "coalesce(s.reject, '')", "selected": "CASE WHEN picked THEN '1' ELSE '0' END", "iso": "coalesce(CAST(q.iso AS VARCHAR), '')", "subject_sharpness": "q.subject_sharpness:2", "composition_bonus": "q.composition_bonus:4",
    "moment": "coalesce(CAST(s.moment AS VARCHAR), '')", "photo_id": "CAST(q.photo_id AS VARCHAR)",
}


def _report_sql() -> str:
    out = []
    for name, _ in reporting.FORMS:
        e = _REPORT_SQL.get(name, "''")
        if ":" in e and e.rsplit(":", 1)[1].isdigit():
            c, d = e.rsplit(":", 1)
            e = f"CASE WHEN {c} IS NULL THEN '' ELSE printf('%.{d}f', {c}) END"
        out.append(f"{e} AS {name}")
    return SEL + "SELECT " + ", ".join(out) + " FROM sel s JOIN (SELECT DISTINCT ON (photo_id) * FROM photos ORDER BY photo_id) q ON q.path = s.id"


@REVIEW.add("report_whole", _report_sql())
def report_whole(spark, sf):
    """The whole report of every photo, with all its columns."""
    more = table(spark, sf, "photos").select("photo_id", F.col("time").alias("datetime"), "label_prob", "person", "subject", "edge", "sharpness", "clip_low", "clip_high", "iso", "subject_sharpness", "composition_bonus").dropDuplicates(["photo_id"])
    rows = selections(spark, sf).join(more, "photo_id").withColumn("file", F.col("id")).withColumn("selected", F.col("picked"))
    return reporting.whole_report(rows, [F.col("day"), F.col("label"), F.col("file")])


@REVIEW.add(
    "sidecar_keywords",
    SEL + """SELECT id, array_to_string(list_filter(['Glean', 'Glean|' || coalesce(label, ''), CASE WHEN picked THEN 'Glean|Pick' END, CASE WHEN picked AND coalesce(reject, '') <> '' THEN 'Glean|Preset|' || reject END], lambda x: x IS NOT NULL), ';') AS words,
CASE WHEN coalesce(picked, false) THEN 'Suggested pick' ELSE 'Alternative' END AS badge FROM sel""",
)
def sidecar_keywords(spark, sf):
    from gleanframe.functions import scalars

    words = reporting.keywords("Glean", F.col("label"), F.col("picked"), F.col("reject"), F.lit(None).cast("string"))
    return selections(spark, sf).select("id", F.array_join(words, ";").alias("words"), scalars.badge(F.lit(""), F.col("picked")).alias("badge"))


@REVIEW.add("label_counts", SEL + "SELECT coalesce(label, '') AS label, count(*) AS picks FROM sel WHERE picked GROUP BY 1")
def label_counts(spark, sf):
    """How many picks every label has, the most first."""
    return selections(spark, sf).where("picked").groupBy(F.coalesce("label", F.lit("")).alias("label")).agg(F.count("*").alias("picks")).orderBy(F.desc("picks"), "label")
