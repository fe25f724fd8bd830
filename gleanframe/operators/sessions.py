"""Sessions: activity of a key between pauses, as merging interval state.

Every event opens the interval ``[t, t + gap]``; intervals of a key that touch merge. Merging is associative, so it is done in two
levels: first inside time buckets of each key (many tasks, also for a key that holds a large share of all rows), then between the
buckets of a key through one small row per bucket. No task ever sees all events of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.session import col


def _micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def mark_sessions(events: DataFrame, key: str, time: str, gap_seconds: float = 120.0, bucket_seconds: int = 3600) -> DataFrame:
    """One row per distinct ``(key, time)`` with the start of its session: columns ``key, t, session_t`` (t in microseconds).

    An event more than ``gap_seconds`` after the one before opens a new session; at exactly the gap it does not. Rows without key or
    time are left out. ``bucket_seconds`` only shapes the work, not the result; it must not be shorter than the gap.
    """
    gap = int(round(gap_seconds * 1_000_000))
    width = max(int(bucket_seconds * 1_000_000), gap + 1)
    # equal times of a key are one interval; this also shrinks a clock stuck at one value before the shuffle
    points = events.select(col(key).alias("key"), _micros(col(time)).alias("t")).where(F.col("key").isNotNull() & F.col("t").isNotNull()).distinct()
    merged = merge_intervals(points.select("key", F.col("t").alias("s"), (F.col("t") + gap).alias("e")), width)
    return merged.select("key", F.col("s").alias("t"), F.col("merged_s").alias("session_t"))


def merge_intervals(rows: DataFrame, width: int) -> DataFrame:
    """``key, s, e, merged_s`` of intervals ``key, s, e`` (distinct, numbers, s <= e): the start of the union of intervals that touch.

    Two levels, as merging is associative: first inside buckets of ``width``, then between the buckets of a key, through one row that
    holds the bucket's last end and one with the start of the last union that began inside it. Intervals may be of any length: single
    events with their gap, or unions merged before.
    """
    rows = rows.select("key", "s", "e", F.floor(F.col("s") / width).alias("bucket"))
    local = Window.partitionBy("key", "bucket").orderBy("s", "e")
    ahead = local.rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("reach", F.max("e").over(ahead))
    state = inside.groupBy("key", "bucket").agg(F.max("e").alias("last_e"))
    # an interval may reach over whole buckets, so the ends of all before count
    across = Window.partitionBy("key").orderBy("bucket")
    upto = across.rowsBetween(Window.unboundedPreceding, -1)
    joined = inside.join(state.select("key", "bucket", F.max("last_e").over(upto).alias("before_e")), ["key", "bucket"])
    starts = F.when((F.col("reach").isNull() | (F.col("s") > F.col("reach"))) & (F.col("before_e").isNull() | (F.col("s") > F.col("before_e"))), F.col("s"))
    marked = joined.withColumn("own", F.max(starts).over(local.rowsBetween(Window.unboundedPreceding, 0)))
    # the start that a bucket hands on: its last own one, else that of the bucket before
    last = joined.withColumn("st", starts).groupBy("key", "bucket").agg(F.max("st").alias("last_start"))
    handed = last.withColumn("carry", F.last("last_start", ignorenulls=True).over(upto)).select("key", "bucket", "carry")
    return marked.join(handed, ["key", "bucket"]).select("key", "s", "e", F.coalesce("own", "carry").alias("merged_s"))


def on_time(events: DataFrame, key: str, time: str, arrival: Column, lateness_seconds: float) -> DataFrame:
    """The events with ``on_time``: whether an event stands at or after its key's watermark when it arrives.

    ``arrival`` orders the batches events come in; a key's watermark is the greatest time of all batches before less the lateness. One row
    per key and batch carries it. Events without key, time or arrival have NULL.
    """
    late = int(round(lateness_seconds * 1_000_000))
    rows = events.withColumn("ot_batch", arrival).withColumn("ot_t", _micros(col(time)))
    tops = rows.where(col(key).isNotNull() & F.col("ot_t").isNotNull() & F.col("ot_batch").isNotNull()).groupBy(col(key).alias("ot_key"), F.col("ot_batch").alias("ot_b")).agg(F.max("ot_t").alias("top"))
    before = Window.partitionBy("ot_key").orderBy("ot_b").rowsBetween(Window.unboundedPreceding, -1)
    marks = tops.withColumn("mark", F.max("top").over(before) - late).withColumn("ot_known", F.lit(True)).drop("top")
    j = rows.join(marks, (col(key) == F.col("ot_key")) & (F.col("ot_batch") == F.col("ot_b")), "left")
    good = F.when(F.col("ot_known") & F.col("ot_t").isNotNull(), F.col("mark").isNull() | (F.col("ot_t") >= F.col("mark")))
    return j.select(*[col(c) for c in events.columns if c != "on_time"], good.alias("on_time"))


def sessionize(
    events: DataFrame,
    key: str,
    time: str,
    event_id: str,
    gap_seconds: float = 120.0,
    group_of: Sequence[str] = (),
    missing_group: Column | None = None,
    bucket_seconds: int = 3600,
) -> DataFrame:
    """Sessions of each key: ``<key>, session_start, session_end, duration_s, events, groups, first_<id>, last_<id>``.

    ``events`` counts distinct ``event_id``; ``groups`` counts distinct combinations of the ``group_of`` columns (rows for which
    ``missing_group`` holds, or with a NULL among them, do not count). ``first_<id>`` is the smallest id at the earliest time,
    ``last_<id>`` the largest at the latest time.

    Defined cases: rows without key or time are left out; a NULL ``event_id`` never counts; repeated rows count once; an event id at
    two times belongs to both; an empty table gives no rows; further columns are ignored, whatever their names.
    """
    gap = int(round(gap_seconds * 1_000_000))
    width = max(int(bucket_seconds * 1_000_000), gap + 1)
    group = F.struct(*[col(c) for c in group_of]) if group_of else F.lit(None).cast("string")
    if group_of:
        known = F.lit(True)
        for c in group_of:
            known = known & col(c).isNotNull()
        if missing_group is not None:
            known = known & ~F.coalesce(missing_group, F.lit(False))
        group = F.when(known, F.xxhash64(*[col(c) for c in group_of]))
    rows = events.select(col(key).alias("key"), _micros(col(time)).alias("t"), col(event_id).alias("id"), group.alias("grp")).where(
        F.col("key").isNotNull() & F.col("t").isNotNull()
    )
    # one row per (key, time): repeated deliveries and stuck clocks collapse map-side
    ticks = rows.groupBy("key", "t", "id", "grp").agg(F.lit(1).alias("x"))
    points = ticks.select("key", F.col("t").alias("s"), (F.col("t") + gap).alias("e")).distinct()
    starts = merge_intervals(points, width).select("key", F.col("s").alias("t"), F.col("merged_s").alias("session_t"))
    tagged = ticks.join(starts, ["key", "t"]).select("key", "session_t", "t", "id", "grp")
    # count distinct ids and groups by first collapsing (session, id) and (session, group): no set grows in one task
    ids = tagged.groupBy("key", "session_t", "id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    spans = ids.groupBy("key", "session_t").agg(
        F.max("t1").alias("end_t"),
        F.count("id").alias("events"),
        F.min(F.struct(F.col("t0").alias("t"), F.col("id").isNull().alias("n"), F.col("id").alias("id"))).alias("head"),
        F.max(F.struct(F.col("t1").alias("t"), F.col("id").alias("id"))).alias("tail"),
    )
    out = spans
    if group_of:
        groups = tagged.where(F.col("grp").isNotNull()).groupBy("key", "session_t", "grp").agg(F.lit(1).alias("x"))
        groups = groups.groupBy("key", "session_t").agg(F.count("*").alias("groups"))
        out = out.join(groups, ["key", "session_t"], "left")
    else:
        out = out.withColumn("groups", F.lit(0).cast("long"))
    return out.select(
        F.col("key").alias(key),
        F.timestamp_micros("session_t").alias("session_start"),
        F.timestamp_micros("end_t").alias("session_end"),
        ((F.col("end_t") - F.col("session_t")) / 1_000_000).alias("duration_s"),
        "events",
        F.coalesce("groups", F.lit(0)).cast("long").alias("groups"),
        F.col("head.id").alias(f"first_{event_id}"),
        F.col("tail.id").alias(f"last_{event_id}"),
    )
