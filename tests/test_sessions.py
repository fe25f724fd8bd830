"""Sessions against a plain walk over sorted events, and the defined cases."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleanframe.operators.sessions import mark_sessions, sessionize

T0 = datetime(2021, 3, 1, 12)
DDL = "id long, cam string, t timestamp, shoot string, burst int"


def at(s):
    return T0 + timedelta(seconds=s)


def walk(rows, gap=120.0):
    """Brute force: first id, last id, events and bursts of each session."""
    out = []
    for cam in {r[1] for r in rows if r[1] is not None}:
        ev = sorted({r for r in rows if r[1] == cam and r[2] is not None}, key=lambda r: (r[2], r[0]))
        part = []
        for r in [*ev, None]:
            if part and (r is None or (r[2] - part[-1][2]).total_seconds() > gap):
                t0, t1 = part[0][2], part[-1][2]
                bursts = {(x[3], x[4]) for x in part if x[3] is not None and x[4] not in (None, -1)}
                out.append((cam, min(x[0] for x in part if x[2] == t0), max(x[0] for x in part if x[2] == t1), len({x[0] for x in part}), len(bursts), (t1 - t0).total_seconds()))
                part = []
            if r is not None:
                part.append(r)
    return sorted(out)


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, DDL)
    got = sessionize(df, "cam", "t", "id", 120.0, ["shoot", "burst"], F.col("burst") == -1, **how)
    return sorted((r["cam"], r["first_id"], r["last_id"], r["events"], r["groups"], r["duration_s"]) for r in got.collect())


@pytest.mark.parametrize("bucket", [200, 3600, 86400])
def test_equals_walk_whatever_the_buckets(spark, bucket):
    r = random.Random(4)
    rows = []
    for i in range(600):
        cam = r.choice(["a", "a", "a", "b", "c", None])
        t = None if r.random() < 0.05 else at(r.randrange(0, 40_000))
        rows.append((i, cam, t, r.choice(["s", "u", None]), r.choice([-1, None, 1, 2, 3])))
    rows += rows[:50]
    assert run(spark, rows, bucket_seconds=bucket) == walk(rows)


def test_exact_gap_stays_together(spark):
    rows = [(1, "a", at(0), "s", 1), (2, "a", at(120), "s", 1), (3, "a", at(240.000001), "s", 2)]
    assert [x[:4] for x in run(spark, rows)] == [("a", 1, 2, 2), ("a", 3, 3, 1)]


def test_long_chain_over_many_buckets_is_one_session(spark):
    rows = [(i, "a", at(100 * i), "s", i % 7) for i in range(400)]
    assert run(spark, rows, bucket_seconds=130) == [("a", 0, 399, 400, 7, 39900.0)]


def test_equal_times_and_wrong_clocks(spark):
    rows = [(i, "a", datetime(1980, 1, 1), "s", 1) for i in range(300)] + [(900, "a", at(0), "s", 1)]
    assert [x[:4] for x in run(spark, rows)] == [("a", 0, 299, 300), ("a", 900, 900, 1)]


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "a", at(0), "s", 1)], DDL).withColumn("key", F.lit(1)).withColumn("bucket", F.lit(2)).withColumn("session_t", F.lit(3))
    assert sessionize(df, "cam", "t", "id").count() == 1
    odd = df.withColumnRenamed("cam", "the.key").withColumnRenamed("t", "a time")
    assert mark_sessions(odd, "the.key", "a time").count() == 1


def test_null_ids_do_not_count(spark):
    df = spark.createDataFrame([(None, "a", at(0), "s", 1), (5, "a", at(1), "s", 1)], DDL)
    row = sessionize(df, "cam", "t", "id").first()
    assert (row["events"], row["session_start"]) == (1, at(0))


def test_stream_sessions_merge_late_events(spark, tmp_path):
    from gleanframe.streaming.sessions import stream_sessions

    src = tmp_path / "in"
    src.mkdir()
    batches = [[("a", at(0), 1), ("a", at(200), 2), ("a", at(200), 2)], [("a", at(100), 3), ("b", at(300), 4)], [("z", at(5000), 9)], [("z", at(9000), 10)]]
    events = spark.readStream.schema("cam string, t timestamp, id long").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = stream_sessions(events, "cam", "t", "id", 120, "10 minutes").writeStream.format("memory").queryName("late_sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for b in batches:
            spark.createDataFrame(b, "cam string, t timestamp, id long").coalesce(1).write.mode("append").parquet(str(src))
            q.processAllAvailable()
        got = {(r["cam"], r["session_start"], r["session_end"], r["events"]) for r in spark.table("late_sessions").collect()}
    finally:
        q.stop()
    assert ("a", at(0), at(200), 3) in got and ("b", at(300), at(300), 1) in got


def test_unions_of_intervals_of_any_length(spark):
    from gleanframe.operators.sessions import merge_intervals

    r = random.Random(2)
    rows = list({(r.choice("ab"), s, s + r.choice([3, 10, 10, 400])) for s in (r.randrange(5000) for _ in range(300))})
    got = {(x["key"], x["s"], x["e"]): x["merged_s"] for x in merge_intervals(spark.createDataFrame(rows, "key string, s long, e long"), 50).collect()}
    for k in "ab":
        start = end = None
        for s, e in sorted((s, e) for a, s, e in rows if a == k):
            if end is None or s > end:
                start, end = s, e
            end = max(end, e)
            assert got[k, s, e] == start


def test_session_log_equals_the_batch_form_with_its_watermark(spark, tmp_path):
    """Batches with late events, one of them delivered twice: the log, the watermark rule of the batch form and a plain walk agree."""
    from gleanframe.operators.sessions import on_time
    from gleanframe.streaming.sessions import SessionLog

    r = random.Random(3)
    rows = []
    for b in range(4):
        for i in range(60):
            rows.append((b, r.choice("xy"), at(b * 1500 + r.randrange(-2500, 1500)), 100 * b + i))
    ddl = "b int, cam string, t timestamp, id long"
    log = SessionLog(str(tmp_path / "log"), "cam", "t", "id", 120.0, 600.0)
    for b in range(4):
        for _ in range(2 if b == 1 else 1):
            log(spark.createDataFrame([x for x in rows if x[0] == b], ddl), b)
    got = sorted((x["key"], x["session_start"], x["session_end"], x["events"]) for x in log.sessions(spark, 3).collect())
    kept = on_time(spark.createDataFrame(rows, ddl), "cam", "t", F.col("b"), 600.0)
    batch = sorted((x["cam"], x["session_start"], x["session_end"], x["events"]) for x in sessionize(kept.where("on_time"), "cam", "t", "id").collect())
    mark, good = {}, []
    for b in range(4):
        now = [x for x in rows if x[0] == b]
        good += [(x[3], x[1], x[2], "s", 1) for x in now if x[1] not in mark or x[2] >= mark[x[1]]]
        for c in "xy":
            mark[c] = max([mark.get(c, datetime.min)] + [x[2] - timedelta(seconds=600) for x in now if x[1] == c])
    assert 0 < len(good) < len(rows)
    assert [(c, n) for c, _, _, n in got] == [(c, n) for c, _, _, n in batch] and got == batch
    assert sorted((c, n, d) for c, _, _, n, _, d in walk(good)) == sorted((c, n, (e - s).total_seconds()) for c, s, e, n in got)
    late = sum(x["late"] for x in spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "log" / "late")).collect())
    assert late == len(rows) - len(good)


def test_latest_by_key_hands_on_the_number(spark):
    from gleanframe.streaming.sessions import latest_by_key

    seen = {}
    run_batch = latest_by_key(lambda df, n: seen.__setitem__(n, [tuple(x) for x in df.collect()]), "k", "o")
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, o int, v string")
    run_batch(df, 7), run_batch(df, 7)
    assert seen == {7: [("a", 2, "y")]}
