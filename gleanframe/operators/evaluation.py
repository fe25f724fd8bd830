"""Evaluation of saved selections with a third truth value: unknown outcomes never count as misses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shown(raw: Column, recorded: Column, available: Column, status: Column) -> Column:
    """Was an item shown? NULL (unknown) where the report recorded no exposure at all, the file is not available or it was never judged."""
    return F.when((raw == "") | raw.isNull() | ~recorded | ~available | (status == "unevaluated"), None).otherwise(raw == "1")


def picked(auto: Column, selected: Column, present: Column, forced: Column, available: Column, status: Column) -> Column:
    """Did the selection pick an item by itself? NULL for absent rows, forced picks, unavailable files and unfinished judgments."""
    return F.when(~present | forced | ~available | status.isin("unevaluated", "incomplete", "failed"), None).otherwise(F.coalesce(auto, selected) == "1")


def group_verdicts(members: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys, verdict``: a group is a hit if any member is true, else unknown if any is NULL, else a miss (false)."""
    g = members.groupBy(*keys).agg(F.bool_or(value).alias("any"), F.count_if(F.col(value).isNull()).alias("open"))
    return g.select(*keys, F.when(F.coalesce("any", F.lit(False)), True).when(F.col("open") > 0, None).otherwise(False).alias("verdict"))


def recall(hits: Column, total: Column, unknown: Column) -> dict[str, Column]:
    """Recall only where nothing is unknown, and its bounds."""
    every = total + unknown
    return {
        "recall": F.when((total > 0) & (unknown == 0), hits / total),
        "recall_lower": F.when(every > 0, hits / every),
        "recall_upper": F.when(every > 0, (hits + unknown) / every),
    }


def recall_counts(verdicts: DataFrame, keys: Sequence[str], verdict: str = "verdict") -> DataFrame:
    """``keys, hits, total, unknown, recall, recall_lower, recall_upper``; further groupings add the counts up, never the ratios."""
    c = verdicts.groupBy(*keys).agg(F.count_if(F.col(verdict)).alias("hits"), F.count(verdict).alias("total"), F.count_if(F.col(verdict).isNull()).alias("unknown"))
    return c.select("*", *[e.alias(n) for n, e in recall(F.col("hits"), F.col("total"), F.col("unknown")).items()])


def add_up(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Micro-averages: counts of coarser keys from counts of finer ones."""
    c = counts.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in ("hits", "total", "unknown")])
    return c.select("*", *[e.alias(n) for n, e in recall(F.col("hits"), F.col("total"), F.col("unknown")).items()])


def delta(candidate: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, recall_delta``: only where neither has unknowns and both count the same number of groups."""
    b = baseline.select(*keys, F.col("recall").alias("b_recall"), F.col("total").alias("b_total"), F.col("unknown").alias("b_unknown"))
    ok = (F.col("unknown") == 0) & (F.col("b_unknown") == 0) & (F.col("total") == F.col("b_total")) & (F.col("total") > 0)
    return candidate.join(b, list(keys)).select(*keys, F.when(ok, F.col("recall") - F.col("b_recall")).alias("recall_delta"))


def pair_outcomes(preferences: DataFrame, verdicts: DataFrame, keys: Sequence[str], item: str, value: str) -> DataFrame:
    """``keys, winner, loser, outcome``: what the selection did with each preferred pair."""
    v = verdicts.select(*keys, item, value)
    a = v.select(*keys, F.col(item).alias("winner"), F.col(value).alias("won"))
    b = v.select(*keys, F.col(item).alias("loser"), F.col(value).alias("lost"))
    j = preferences.join(a, [*keys, "winner"], "left").join(b, [*keys, "loser"], "left")
    outcome = F.when(F.col("won").isNull() | F.col("lost").isNull(), "unknown").when(F.col("won") & F.col("lost"), "both").when(F.col("won"), "preferred_only").when(F.col("lost"), "other_only").otherwise("neither")
    return j.select(*keys, "winner", "loser", outcome.alias("outcome"))


def redundant(members: DataFrame, keys: Sequence[str], group: Sequence[str], value: str) -> DataFrame:
    """``keys, excess, fully_evaluated``: picks beyond the first of each group, and groups without an unknown member."""
    g = members.groupBy(*keys, *group).agg(F.count_if(F.coalesce(F.col(value), F.lit(False))).alias("n"), F.count_if(F.col(value).isNull()).alias("open"))
    return g.groupBy(*keys).agg(F.sum(F.greatest(F.col("n") - 1, F.lit(0))).cast("long").alias("excess"), F.count_if(F.col("open") == 0).alias("fully_evaluated"))


def corrections(verdicts: DataFrame, favourites: DataFrame, rejected: DataFrame, keys: Sequence[str], item: str, value: str) -> DataFrame:
    """``keys, item, action``: favourites surely left out are to add, rejected ones surely picked to remove."""
    known = verdicts.select(*keys, item, value).where(F.col(value).isNotNull())
    add = known.where(~F.col(value)).join(favourites.select(*keys, item).distinct(), [*keys, item], "left_semi").select(*keys, item, F.lit("add").alias("action"))
    drop = known.where(F.col(value)).join(rejected.select(*keys, item).distinct(), [*keys, item], "left_semi").select(*keys, item, F.lit("remove").alias("action"))
    return add.unionByName(drop)


def within_budget(count: Column, limit: Column, unknown: Column) -> Column:
    """False as soon as the count exceeds the limit, true only where nothing is unknown, else NULL."""
    return F.when(limit.isNull(), None).when(count > limit, False).when(unknown == 0, True)


# ---- a run against what was declared -----------------------------------------------------------------------------------------------

COUNTERS = [
    "eligible", "report_rows", "missing_files", "changed_files", "files_unverified", "unevaluated", "incomplete_judgments", "failed_judgments", "unknown_judgments",
    "shortlist_unknown", "not_shortlisted", "human_forced",
]


def match_declared(report: DataFrame, declared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The report's rows with the declared ``id`` they stand for: by ``photo_id``, else by ``file``. A row that stands for none, and two rows
    that stand for one, are errors: they are counted first and nothing is returned."""
    ids = declared.select(*[F.col(k).alias(f"md_{k}") for k in keys], F.col("id").alias("by_id"))
    files = declared.groupBy(*keys, F.col("file").alias("by_file")).agg(F.min("id").alias("file_id"))
    r = report.join(ids, [*[F.col(k) == F.col(f"md_{k}") for k in keys], F.col("photo_id") == F.col("by_id")], "left").drop(*[f"md_{k}" for k in keys])
    r = r.join(files.withColumnsRenamed({k: f"mf_{k}" for k in keys}), [*[F.col(k) == F.col(f"mf_{k}") for k in keys], F.col("file") == F.col("by_file")], "left").drop(*[f"mf_{k}" for k in keys], "by_file")
    r = r.withColumn("id", F.coalesce("by_id", "file_id")).drop("by_id", "file_id")
    told = r.groupBy(*keys, "id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("id").isNull()).alias("strange"), F.count_if((F.col("n") > 1) & F.col("id").isNotNull()).alias("twice")).first()
    if told["strange"] or told["twice"]:
        raise ValueError(f"the report holds rows outside the declared set or several for one item ({told['strange']}, {told['twice']})")
    return r


def judged_states(declared: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, id, source, status, was_shown, was_picked, forced, in_report`` of every declared item.

    ``declared`` has ``keys, id, source`` (available, missing, changed or unverified) and ``judgment`` (of the run, or NULL); ``rows`` has
    ``keys, id, shortlisted, selected, auto_selected, judge_reason, auto_decision, reject``. The status is ``unevaluated`` without a readable
    row, ``failed`` where the reason says so, else the judgment. Exposure is unknown where a whole report shortlists nothing.
    """
    r = rows.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("id").alias("r_id"), "shortlisted", "selected", "auto_selected", "judge_reason", "auto_decision", "reject", F.lit(True).alias("in_report"))
    seen = rows.groupBy(*keys).agg(F.max(F.col("shortlisted") == "1").alias("recorded"))
    j = declared.join(r, [*[F.col(k) == F.col(f"r_{k}") for k in keys], F.col("id") == F.col("r_id")], "left").join(seen, list(keys), "left")
    here = F.coalesce("in_report", F.lit(False))
    status = F.when(~here | (F.col("reject") == "unreadable"), "unevaluated").when(F.col("judgment").isNull() & F.lower("judge_reason").contains("judge failed"), "failed").otherwise(F.col("judgment"))
    j = j.withColumn("status", status).withColumn("in_report", here)
    reason = F.lower(F.coalesce("judge_reason", F.lit(""))) == "forced by --include"
    forced = here & reason & (F.col("auto_selected").isNull() | (F.col("auto_decision") == "Forced by --include"))
    there = ~F.col("source").isin("missing", "changed")
    told = F.coalesce("status", F.lit(""))
    return j.select(
        *keys, "id", "source", "status", forced.alias("forced"), "in_report",
        shown(F.col("shortlisted"), F.coalesce("recorded", F.lit(False)), there, told).alias("was_shown"),
        picked(F.col("auto_selected"), F.col("selected"), here, forced, there, told).alias("was_picked"),
    )


def coverage(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys`` and the twelve counters of :data:`COUNTERS`, with ``candidates`` surely shown and ``picks`` surely made."""
    of = lambda c, v: F.count_if(F.col(c) == v)
    counts = [
        F.count("*"), F.count_if("in_report"), of("source", "missing"), of("source", "changed"), of("source", "unverified"), of("status", "unevaluated"), of("status", "incomplete"),
        of("status", "failed"), F.count_if(F.col("status").isNull()), F.count_if(F.col("was_shown").isNull()), F.count_if(~F.col("was_shown")), F.count_if("forced"),
    ]
    return states.groupBy(*keys).agg(*[c.alias(n) for c, n in zip(counts, COUNTERS)], F.count_if("was_shown").alias("candidates"), F.count_if("was_picked").alias("picks"))


def usage_totals(usage: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``keys`` and of every field the sum of what was measured (NULL where nothing was) and ``<field>_measured``, the runs that measured it."""
    return usage.groupBy(*keys).agg(*[a for f in fields for a in (F.sum(f).alias(f), F.count(f).alias(f"{f}_measured"))])


def same_cohort(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> bool:
    """Whether two tables hold the same set of values of the columns."""
    both = a.select(*columns, F.lit(1).alias("co_a"), F.lit(0).alias("co_b")).unionByName(b.select(*columns, F.lit(0).alias("co_a"), F.lit(1).alias("co_b")))
    return both.groupBy(*columns).agg(F.max("co_a").alias("co_a"), F.max("co_b").alias("co_b")).where("co_a <> co_b").isEmpty()


def comparison(before: DataFrame, after: DataFrame, keys: Sequence[str], item: str, value: str, digest: str) -> DataFrame:
    """``keys, recall_delta, verified`` of two runs over the same items (``keys, item, value, digest``).

    Runs over other items, or that disagree on an item's content, are errors. ``verified`` says whether both know the content of every item;
    the delta is NULL where either run has an unknown outcome or there is none.
    """
    if not same_cohort(before, after, [*keys, item]):
        raise ValueError("the runs do not cover the same items")
    b = before.select(*keys, item, F.col(value).alias("b_value"), F.nullif(F.col(digest), F.lit("")).alias("b_digest"))
    j = after.select(*keys, item, F.col(value).alias("a_value"), F.nullif(F.col(digest), F.lit("")).alias("a_digest")).join(b, [*keys, item])
    if not j.where("a_digest <> b_digest").isEmpty():
        raise ValueError("the runs disagree on the content of an item")
    g = j.groupBy(*keys).agg(F.count_if("a_value").alias("ah"), F.count_if("b_value").alias("bh"), F.count("*").alias("n"), F.count_if(F.col("a_value").isNull() | F.col("b_value").isNull()).alias("open"), F.bool_and(F.col("a_digest").isNotNull() & F.col("b_digest").isNotNull()).alias("verified"))
    return g.select(*keys, F.when(F.col("open") == 0, F.col("ah") / F.col("n") - F.col("bh") / F.col("n")).alias("recall_delta"), "verified")


def feedback(state: DataFrame, include_imported: bool = False) -> DataFrame:
    """``item_id, kind`` of the decisions made one by one: favourites and rejected; those of a ``csv import`` only on request."""
    kept = state if include_imported else state.where(F.coalesce(F.col("origin") != "csv import", F.lit(True)))
    return kept.select("item_id", F.when(F.col("choice") == "keep", "favourite").when(F.col("choice") == "reject", "rejected").alias("kind")).where("kind IS NOT NULL")
