"""Human decisions over automatic results: event log, latest state, undo, overlays and transfers. Automatic and manual columns stay apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.session import col


def latest(events: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The values of each key's last event; one aggregate, so a key with very many events is combined map-side."""
    top = F.max(F.struct(*[col(o) for o in order], *[col(v) for v in values if v not in order])).alias("last")
    return events.groupBy(*keys).agg(top).select(*keys, *[F.col("last").getField(v).alias(v) for v in values])


def latest_preferences(votes: DataFrame, keys: Sequence[str], winner: str, loser: str, order: str) -> DataFrame:
    """The last vote on every unordered pair: ``keys, winner, loser, order``. Votes with a missing end, or of an item on itself, do not count."""
    v = votes.select(*keys, col(winner).alias("w"), col(loser).alias("l"), col(order).alias("o")).dropna(subset=["w", "l"]).where("w <> l")
    last = v.groupBy(*keys, F.least("w", "l").alias("a"), F.greatest("w", "l").alias("b")).agg(F.max(F.struct("o", "w", "l")).alias("x"))
    return last.select(*keys, F.col("x.w").alias("winner"), F.col("x.l").alias("loser"), F.col("x.o").alias(order))


def decisions_at(log: DataFrame, revision: Column | None = None) -> DataFrame:
    """State of a decision log ``revision, relative, item_id, choice, note, origin`` at a revision (the last by default).

    ``keep`` and ``reject`` set an item's decision; ``clear`` removes every earlier decision on its path. Undoing a change is reading an
    earlier revision.
    """
    seen = log if revision is None else log.where(F.col("revision") <= revision)
    cleared = seen.where("choice = 'clear'").groupBy(F.col("relative").alias("c_relative")).agg(F.max("revision").alias("cleared"))
    last = latest(seen.where("choice <> 'clear'"), ["item_id"], ["revision"], ["revision", "relative", "choice", "note", "origin"])
    live = last.join(cleared, F.col("relative") == F.col("c_relative"), "left").where(F.col("cleared").isNull() | (F.col("revision") > F.col("cleared")))
    return live.drop("c_relative", "cleared")


def overlay(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows ``item_id, relative, auto_selected`` with the manual decision: ``selected`` is the manual choice where there is one.

    ``status`` is ``applied``, ``stale decision`` (the path is decided but its content changed) or empty.
    """
    s = state.select(F.col("item_id").alias("s_id"), "choice", "note")
    paths = state.select(F.col("relative").alias("s_rel")).distinct().withColumn("on_path", F.lit(True))
    r = rows.join(s, F.col("item_id") == F.col("s_id"), "left").join(paths, F.col("relative") == F.col("s_rel"), "left")
    manual = F.when(F.col("choice") == "keep", True).when(F.col("choice") == "reject", False)
    status = F.when(F.col("s_id").isNotNull(), "applied").when(F.col("on_path"), "stale decision").otherwise("")
    text = F.when(manual.isNotNull(), F.concat(F.lit("Manual "), F.col("choice"), F.when(F.col("note") != "", F.concat(F.lit(": "), F.col("note"))).otherwise("")))
    return r.select(*[col(c) for c in rows.columns], F.coalesce(manual, F.col("auto_selected")).alias("selected"), F.coalesce(F.col("choice"), F.lit("")).alias("manual_decision"), F.coalesce(text, F.lit("")).alias("manual_reason"), status.alias("status"))


def orphans(state: DataFrame, rows: DataFrame) -> DataFrame:
    """Decisions on paths that no longer exist."""
    return state.join(rows.select("relative").distinct(), "relative", "left_anti")


def moved(state: DataFrame, rows: DataFrame) -> DataFrame:
    """Decisions whose path is gone matched to undecided rows of the same content, only where the content is unique on both sides:
    ``old_relative, new_relative, digest, choice``. ``state`` and ``rows`` need ``relative`` and ``digest``."""
    gone = orphans(state, rows).where("digest IS NOT NULL AND digest <> ''")
    free = rows.join(state.select("relative").distinct(), "relative", "left_anti").where("digest IS NOT NULL AND digest <> ''")
    one = lambda d: d.groupBy("digest").agg(F.count("*").alias("n"), F.min("relative").alias("r"), *([F.min("choice").alias("choice")] if "choice" in d.columns else [])).where("n = 1")
    a, b = one(gone).select("digest", F.col("r").alias("old_relative"), "choice"), one(free).select("digest", F.col("r").alias("new_relative"))
    return a.join(b, "digest").select("old_relative", "new_relative", "digest", "choice")


def resolve(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Report rows ``row, file, relative`` matched to files ``path, relative, name`` in order of trust: absolute path, relative path, then a
    base name that is unique on both sides. Adds ``match`` (``path``, ``relative``, ``name``, ``ambiguous``, ``missing``) and ``found``."""
    f = files.select(F.col("path").alias("f_path"), F.col("relative").alias("f_rel"), F.col("name").alias("f_name"))
    by_path = f.select(F.col("f_path").alias("p_key"), F.col("f_path").alias("p_found")).dropDuplicates(["p_key"])
    by_rel = f.groupBy(F.col("f_rel").alias("r_key")).agg(F.min("f_path").alias("r_found"))
    by_name = f.groupBy(F.col("f_name").alias("n_key")).agg(F.min("f_path").alias("n_found"), F.count("*").alias("n_files"))
    r = rows.withColumn("m_name", F.regexp_extract("file", r"([^/]*)$", 1))
    names = r.groupBy(F.col("m_name").alias("o_name")).agg(F.count("*").alias("n_rows"))
    j = r.join(by_path, F.col("file") == F.col("p_key"), "left").join(by_rel, F.coalesce("relative", "file") == F.col("r_key"), "left")
    j = j.join(by_name, F.col("m_name") == F.col("n_key"), "left").join(names, F.col("m_name") == F.col("o_name"), "left")
    match = F.when(F.col("p_found").isNotNull(), "path").when(F.col("r_found").isNotNull(), "relative").when((F.col("n_files") == 1) & (F.col("n_rows") == 1), "name").when(F.col("n_files").isNotNull(), "ambiguous").otherwise("missing")
    found = F.when(match == "path", F.col("p_found")).when(match == "relative", F.col("r_found")).when(match == "name", F.col("n_found"))
    return j.select(*[col(c) for c in rows.columns], match.alias("match"), found.alias("found"))


def cull_sets(rows: DataFrame, item: str, raw: str, selected: str) -> DataFrame:
    """``raw, keep``: a raw file is kept if any of the items it belongs to is selected, else culled."""
    return rows.where(col(raw).isNotNull()).groupBy(col(raw).alias("raw")).agg(F.bool_or(F.coalesce(col(selected), F.lit(False))).alias("keep"))


def upsert_column(report: DataFrame, key: str, column: str, values: DataFrame) -> DataFrame:
    """The report with ``column`` set from ``values`` (key, column) where they have the key; the column is added if absent."""
    v = values.select(col(key).alias("u_key"), col(column).alias("u_value")).groupBy("u_key").agg(F.max("u_value").alias("u_value"))
    old = col(column) if column in report.columns else F.lit(None)
    j = report.join(v, col(key) == F.col("u_key"), "left")
    keep = [col(c) for c in report.columns if c != column]
    return j.select(*keep, F.coalesce(F.col("u_value"), old).alias(column))


def first_of_each(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Distinct keys, each by its first row in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("fe", F.row_number().over(w)).where("fe = 1").drop("fe")


def exported(rows: DataFrame, state: DataFrame, revision: Column) -> DataFrame:
    """A report with the decisions written into it: ``item_id, relative, auto_selected, auto_decision`` as rows give them, ``selected`` as it
    stands, the manual columns, ``decision`` (the manual text, else the automatic one, also where an override was cleared), and the revision."""
    told = overlay(rows, state)
    decision = F.when(F.col("manual_decision") != "", F.col("manual_reason")).otherwise(F.coalesce("auto_decision", F.lit("")))
    return told.select(*[col(c) for c in rows.columns], "selected", "manual_decision", "manual_reason", decision.alias("decision"), F.col("status").alias("review_status"), revision.cast("long").alias("review_revision"))


def verified(state: DataFrame, files: DataFrame) -> DataFrame:
    """Decisions ``item_id, relative, digest`` against files ``relative, digest``: ``item_id, state`` of ``available``, ``changed`` or ``missing``."""
    f = files.select(F.col("relative").alias("v_rel"), F.col("digest").alias("v_digest")).dropDuplicates(["v_rel"])
    j = state.join(f, F.col("relative") == F.col("v_rel"), "left")
    return j.select("item_id", F.when(F.col("v_rel").isNull(), "missing").when(F.col("digest") != F.col("v_digest"), "changed").otherwise("available").alias("state"))


def attached(rows: DataFrame, path: str, twins: DataFrame) -> DataFrame:
    """The rows with ``source``: the processed twin (``path, twin``) where there is one, else the file itself."""
    t = twins.groupBy(F.col("path").alias("at_path")).agg(F.min("twin").alias("twin"))
    return rows.join(t, col(path) == F.col("at_path"), "left").withColumn("source", F.coalesce("twin", col(path))).drop("at_path", "twin")
