"""Streaming forms of the sequence operators: sessions by merging state under a watermark, and incremental latest states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.operators.sessions import mark_sessions, sessionize
from gleanframe.session import col, forget, materialize


def stream_sessions(events: DataFrame, key: str, time: str, event_id: str, gap_seconds: int = 120, lateness: str = "10 minutes") -> DataFrame:
    """Sessions of a stream: ``key, session_start, session_end, duration_s, events``, emitted once the watermark has passed them.

    Every event opens the interval [t, t + gap]; Spark's session state merges intervals of a key that touch, also when a late event closes
    the space between two sessions. Events later than ``lateness`` behind the latest are dropped by the watermark. As in the batch form, an
    event exactly at the gap still belongs to the session. A repeated event within the watermark counts once.
    """
    good = events.where(col(key).isNotNull() & col(time).isNotNull()).select(col(key).alias("key"), col(time).cast("timestamp").alias("t"), col(event_id).alias("id"))
    once = good.withWatermark("t", lateness).dropDuplicatesWithinWatermark(["key", "id"])
    w = F.session_window("t", f"{gap_seconds} seconds")
    s = once.groupBy("key", w.alias("w")).agg(F.min("t").alias("session_start"), F.max("t").alias("session_end"), F.count("id").alias("events"))
    duration = (F.unix_micros("session_end") - F.unix_micros("session_start")) / 1_000_000
    return s.select(F.col("key").alias(key), "session_start", "session_end", duration.alias("duration_s"), "events")


class SessionLog:
    """A ``foreachBatch`` sink that keeps sessions as tables in a folder, by the same merging of intervals as the batch form.

    Open is what may still grow: the events of sessions whose interval reaches the key's watermark, the greatest time of the batches before
    less ``lateness_seconds``. A batch's events behind the watermark are left out and counted; the others open their intervals, which merge
    with the open ones, so that an event can close the space between two sessions; sessions the new watermark has passed are written out.
    Every table carries the number of its batch and is overwritten when the batch comes again, so a restart changes nothing.
    """

    def __init__(self, folder: str, key: str, time: str, event_id: str, gap_seconds: float = 120.0, lateness_seconds: float = 600.0) -> None:
        self.folder, self.key, self.time, self.event_id = folder, key, time, event_id
        self.gap, self.lateness = gap_seconds, int(round(lateness_seconds * 1_000_000))

    def _read(self, spark, name: str, number: int, ddl: str) -> DataFrame:
        at = f"{self.folder}/{name}/{number}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return spark.read.schema(ddl).parquet(at) if there else spark.createDataFrame([], ddl)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, kinds = batch.sparkSession, dict(batch.dtypes)
        events_ddl, marks_ddl = f"key {kinds[self.key]}, t timestamp, id {kinds[self.event_id]}", f"key {kinds[self.key]}, mark long"
        come = batch.select(col(self.key).alias("key"), col(self.time).cast("timestamp").alias("t"), col(self.event_id).alias("id")).dropna(subset=["key", "t"])
        marks = self._read(spark, "marks", number - 1, marks_ddl)
        good = come.join(marks, "key", "left").withColumn("late", F.coalesce(F.unix_micros("t") < F.col("mark"), F.lit(False)))
        good = materialize(good.select("key", "t", "id", "late"), "come")
        top = good.groupBy("key").agg((F.max(F.unix_micros("t")) - self.lateness).alias("new"))
        now = marks.join(top, "key", "full").select("key", F.greatest("mark", "new").alias("mark"))
        self._write(now, "marks", number)
        now = spark.read.schema(marks_ddl).parquet(f"{self.folder}/marks/{number}")
        events = materialize(self._read(spark, "open", number - 1, events_ddl).unionByName(good.where("NOT late").drop("late")).distinct(), "events")
        found = mark_sessions(events, "key", "t", self.gap)
        ends = found.groupBy("key", "session_t").agg(F.max("t").alias("end_t")).join(now, "key", "left")
        ends = ends.withColumn("passed", F.coalesce(F.col("end_t") + int(round(self.gap * 1_000_000)) < F.col("mark"), F.lit(False)))
        tagged = events.withColumn("m", F.unix_micros("t")).join(found.withColumnRenamed("t", "m"), ["key", "m"]).join(ends.select("key", "session_t", "passed"), ["key", "session_t"])
        tagged = materialize(tagged.select("key", "t", "id", "passed"), "tagged")
        self._write(tagged.where("NOT passed").drop("passed"), "open", number)
        self._write(sessionize(tagged.where("passed"), "key", "t", "id", self.gap).drop("groups"), "closed", number)
        self._write(good.groupBy("key").agg(F.count_if("late").alias("late")).where("late > 0"), "late", number)
        for t in (good, events, tagged):
            forget(t)

    def _write(self, df: DataFrame, name: str, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/{number}")

    def sessions(self, spark, last: int) -> DataFrame:
        """All sessions up to batch ``last``, those still open with what they have: ``key, session_start, session_end, duration_s, events, first_id, last_id, open``."""
        closed = spark.read.option("recursiveFileLookup", True).parquet(f"{self.folder}/closed").withColumn("open", F.lit(False))
        rest = sessionize(spark.read.parquet(f"{self.folder}/open/{last}"), "key", "t", "id", self.gap).drop("groups").withColumn("open", F.lit(True))
        return closed.unionByName(rest)


def latest_by_key(sink: Callable[[DataFrame, int], None], key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that reduces each micro-batch to the last row of every key and hands it to ``sink`` with the batch's number.

    A batch may come again after a restart, under the same number and with the same rows: the sink writes by number, overwriting.
    """

    def run(df: DataFrame, number: int) -> None:
        rest = [c for c in df.columns if c not in (key, order)]
        sink(df.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("x")).select(key, "x.*"), number)

    return run


def stream_scenes(rows: DataFrame, key: str, time: str, item: str, vector: str, gap_seconds: float = 120.0, similarity: float = 0.8, lateness: str = "10 minutes") -> DataFrame:
    """``key, item, scene, late`` of a stream: the scene fold with its running centroid, last time and number kept as state per key.

    Rows of a micro-batch are taken in order of time. A row behind the key's last time cannot change what was given out: it gets the
    current scene and ``late``. State of a key without rows for the watermark's ``lateness`` is dropped, and numbers go on from a count
    that starts anew.
    """
    kind = dict(rows.dtypes)
    good = rows.where(col(key).isNotNull() & col(time).isNotNull()).select(col(key).alias("key"), col(item).alias("item"), col(time).cast("timestamp").alias("t"), col(vector).cast("array<double>").alias("v"))

    def run(k, batches, state):
        import numpy as np
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        scene, last, total = state.get if state.exists else (-1, None, [])
        centre = np.array(total)
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        out = []
        for i, t, v in pd.concat(frames).sort_values(["t", "item"], kind="stable")[["item", "t", "v"]].itertuples(index=False):
            at = t.timestamp()
            late = last is not None and at < last
            x = np.asarray(v, dtype=float) if v is not None else None
            x = x / np.linalg.norm(x) if x is not None and np.linalg.norm(x) > 0 else None
            if not late:
                near = float(x @ centre) / np.linalg.norm(centre) if x is not None and len(centre) == len(x) else None
                if scene < 0 or at - last > gap_seconds or (near is not None and near < similarity):
                    scene, centre = scene + 1, np.array([])
                if x is not None:
                    centre = x if not len(centre) else centre + x
                last = at
            out.append((k[0], i, scene, late))
        state.update((scene, last, centre.tolist()))
        state.setTimeoutTimestamp(max(int(last * 1000), state.getCurrentWatermarkMs()) + 3_600_000)
        yield pd.DataFrame(out, columns=["key", "item", "scene", "late"])

    found = good.withWatermark("t", lateness).groupBy("key").applyInPandasWithState(
        run, f"key {kind[key]}, item {kind[item]}, scene int, late boolean", "scene int, last double, total array<double>", "append", "EventTimeTimeout"
    )
    return found.withColumnsRenamed({"key": key, "item": item})
