"""Places in groups of any size, from one range-partitioned sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.session import col, materialize


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "place") -> DataFrame:
    """The rows with ``out``: the 1-based place of each row among those of its keys in a stated total order.

    Rows are sorted once by keys and order into ranges, which cut a group of any size over many tasks. A row's place is its position in its
    range, less where its group begins there, plus the group's rows in the ranges before; one row per group and range carries these counts.
    NULL keys form a group of their own.
    """
    # the place in the sorted ranges is fixed by writing them; ties would move with the order rows arrive in, so the order must be total
    now = materialize(rows, "unsorted").orderBy(*[col(k) for k in keys], *order).withColumn("nm_at", F.monotonically_increasing_id())
    now = materialize(now, "sorted")
    by = [F.col(f"nm_{i}") for i in range(len(keys))]
    runs = now.groupBy(*[col(k).alias(f"nm_{i}") for i, k in enumerate(keys)], F.shiftright("nm_at", 33).alias("nm_range")).agg(F.min("nm_at").alias("nm_first"), F.count("*").alias("nm_n"))
    before = Window.partitionBy(*by).orderBy("nm_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("nm_before", F.coalesce(F.sum("nm_n").over(before), F.lit(0)))
    on = [F.shiftright("nm_at", 33) == F.col("nm_range"), *[col(k).eqNullSafe(b) for k, b in zip(keys, by)]]
    placed = now.join(runs, on).withColumn(out, F.col("nm_at") - F.col("nm_first") + F.col("nm_before") + 1)
    return placed.select(*[col(c) for c in rows.columns if c != out], out)


def medians(rows: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """``keys, out``: the exact median of the known values of each group of any size, the mean of the two middle ones of an even number.

    The values are sorted into ranges; only the one or two rows in a group's middle are averaged. Groups without a value have no row.
    """
    r = rows.select(*[col(k) for k in keys], col(value).cast("double").alias("md_v")).where(F.col("md_v").isNotNull() & ~F.isnan("md_v"))
    r = numbered(r, keys, [F.col("md_v")], "md_at")
    n = r.groupBy(*[col(k).alias(f"md_{i}") for i, k in enumerate(keys)]).agg(F.max("md_at").alias("md_n"))
    on = [col(k).eqNullSafe(F.col(f"md_{i}")) for i, k in enumerate(keys)]
    # one row a group tells its size, so the middle is known before anything is joined to all rows
    mid = r.join(n, on).where((2 * F.col("md_at") - F.col("md_n")).isin(0, 1, 2) & (F.col("md_at") >= F.col("md_n") / 2) & (F.col("md_at") <= F.col("md_n") / 2 + 1))
    return mid.groupBy(*[col(k) for k in keys]).agg(F.avg("md_v").alias(out))
