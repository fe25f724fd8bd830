"""Queries on sessions (problem 4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanframe.operators.sessions import on_time, sessionize
from gleanframe.plans.registry import Registry, table

SESSIONS = Registry()

_RUNS = """
WITH p AS (SELECT DISTINCT photo_id, camera, time, shoot, burst FROM photos WHERE camera IS NOT NULL AND time IS NOT NULL),
ticks AS (SELECT DISTINCT camera, time FROM p),
marked AS (SELECT camera, time, CASE WHEN lag(time) OVER w IS NULL OR epoch_us(time) - epoch_us(lag(time) OVER w) > 120000000 THEN 1 ELSE 0 END AS opens
           FROM ticks WINDOW w AS (PARTITION BY camera ORDER BY time)),
numbered AS (SELECT camera, time, sum(opens) OVER (PARTITION BY camera ORDER BY time ROWS UNBOUNDED PRECEDING) AS s FROM marked),
t AS (SELECT p.*, n.s, min(p.time) OVER (PARTITION BY p.camera, n.s) AS t0, max(p.time) OVER (PARTITION BY p.camera, n.s) AS t1
      FROM p JOIN numbered n ON p.camera = n.camera AND p.time = n.time)
"""


def _photo_sessions(spark, sf):
    photos = table(spark, sf, "photos").select("photo_id", "camera", "time", "shoot", "burst")
    return sessionize(photos, "camera", "time", "photo_id", 120.0, ["shoot", "burst"], F.col("burst") == -1)


@SESSIONS.add(
    "p4_found",
    _RUNS + "SELECT camera, min(CASE WHEN time = t0 THEN photo_id END) AS first_photo_id, "
    "max(CASE WHEN time = t1 THEN photo_id END) AS last_photo_id FROM t GROUP BY camera, s",
)
def p4_found(spark, sf):
    return _photo_sessions(spark, sf).select("camera", "first_photo_id", "last_photo_id").distinct()


@SESSIONS.add(
    "p4_sessions",
    _RUNS + "SELECT camera, t0 AS session_start, t1 AS session_end, (epoch_us(t1) - epoch_us(t0)) / 1000000.0 AS duration_s, "
    "count(DISTINCT photo_id) AS photos, count(DISTINCT CASE WHEN burst <> -1 THEN shoot || '/' || burst END) AS bursts "
    "FROM t GROUP BY camera, s, t0, t1",
)
def p4_sessions(spark, sf):
    return _photo_sessions(spark, sf).select(
        "camera",
        F.col("session_start").cast("timestamp_ntz").alias("session_start"),
        F.col("session_end").cast("timestamp_ntz").alias("session_end"),
        "duration_s",
        F.col("events").alias("photos"),
        F.col("groups").alias("bursts"),
    )


_LATE = """
WITH b AS (SELECT DISTINCT photo_id, camera, time, date_trunc('day', ingested_at) AS batch FROM photos WHERE camera IS NOT NULL AND time IS NOT NULL AND ingested_at IS NOT NULL),
tops AS (SELECT camera, batch, max(time) AS top FROM b GROUP BY 1, 2),
marks AS (SELECT camera, batch, max(top) OVER (PARTITION BY camera ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 DAY AS mark FROM tops),
f AS (SELECT photo_id, camera, time, bool_or(mark IS NULL OR time >= mark) AS good FROM b JOIN marks USING (camera, batch) GROUP BY 1, 2, 3),
p AS (SELECT * FROM f WHERE good), ticks AS (SELECT DISTINCT camera, time FROM p),
marked AS (SELECT camera, time, CASE WHEN lag(time) OVER w IS NULL OR epoch_us(time) - epoch_us(lag(time) OVER w) > 120000000 THEN 1 ELSE 0 END AS opens
           FROM ticks WINDOW w AS (PARTITION BY camera ORDER BY time)),
numbered AS (SELECT camera, time, sum(opens) OVER (PARTITION BY camera ORDER BY time ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT p.camera, min(p.time) AS session_start, max(p.time) AS session_end, count(DISTINCT photo_id) AS photos FROM p JOIN numbered n ON p.camera = n.camera AND p.time = n.time GROUP BY p.camera, s
"""


@SESSIONS.add("p4_late", _LATE)
def p4_late(spark, sf):
    """Sessions as they stand when photos come in by the day and what is over two days behind its camera's latest photo is left out."""
    photos = table(spark, sf, "photos").select("photo_id", "camera", "time", "ingested_at")
    kept = on_time(photos, "camera", "time", F.date_trunc("day", "ingested_at"), 2 * 86400.0).where("on_time")
    out = sessionize(kept, "camera", "time", "photo_id", 120.0)
    return out.select("camera", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), F.col("events").alias("photos"))
