"""One ranking from several differently scaled scores: leximin over percentiles.

Each score becomes the item's percentile inside its group, each item's percentiles are sorted ascending, and the sorted vectors are
compared lexicographically: the item whose weakest score is strongest comes first, so no scale and no single extreme value decides.

Ordinary groups are ranked by one shuffle on the group. Groups above ``split_rows`` rows are cut at quantiles of each score into
pieces of bounded size, ranked piecewise and offset by the counts below; values that repeat across quantiles get a piece of their own
whose rank needs no sort. Both ways give the same percentiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.operators.ranks import numbered
from gleanframe.session import col, materialize


def percentiles(rows: DataFrame, group: str, item: str, scores: Sequence[str], split_rows: int = 200_000) -> DataFrame:
    """``group, item, p0..``: mid-rank percentiles in (0, 1) among the values present in the group; 0 where the score is missing.

    An item delivered again counts once (with its greatest values); a NULL group or item does not count; not-a-number is missing.
    """
    s = [f"s{i}" for i in range(len(scores))]
    clean = lambda c: F.when(F.isnan(col(c).cast("double")), None).otherwise(col(c).cast("double") + F.lit(0.0))
    base = rows.select(col(group).alias("grp"), col(item).alias("item"), *[clean(c).alias(a) for c, a in zip(scores, s)]).dropna(subset=["grp", "item"])
    sizes = base.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > split_rows)
    largest = sizes.orderBy(F.desc("n")).limit(1001).collect()
    hot = [r["grp"] for r in largest]
    sizes = sizes.select("grp")
    if not hot:
        return _whole(base, s)
    if len(hot) <= 1000:  # a short list is a literal, a long one a join
        is_hot = F.col("grp").isin(hot)
        return _whole(base.where(~is_hot), s).unionByName(_pieces(base.where(is_hot), s, largest[0]["n"], split_rows))
    sizes = materialize(sizes, "hot")
    return _whole(base.join(sizes, "grp", "left_anti"), s).unionByName(_pieces(base.join(sizes, "grp", "left_semi"), s, largest[0]["n"], split_rows))


def _mid(rank: Column, ties: Column, n: Column) -> Column:
    """Middle of the ranks of equal values, as a share of the group."""
    return (rank - 1 + (ties + 1) / 2 - F.lit(0.5)) / n


def _whole(base: DataFrame, s: Sequence[str]) -> DataFrame:
    # partitioned by group first, so that removing repeats and all windows share this one exchange
    once = base.repartition("grp").groupBy("grp", "item").agg(*[F.max(a).alias(a) for a in s])
    out = once
    for i, a in enumerate(s):
        by = Window.partitionBy("grp").orderBy(F.col(a).asc_nulls_last())
        same = Window.partitionBy("grp", a)
        out = out.withColumn(f"r{i}", F.rank().over(by)).withColumn(f"t{i}", F.count(a).over(same))
    n = Window.partitionBy("grp")
    return out.select(
        "grp", "item",
        *[F.when(F.col(a).isNull(), 0.0).otherwise(_mid(F.col(f"r{i}"), F.col(f"t{i}"), F.count(a).over(n))).alias(f"p{i}") for i, a in enumerate(s)],
    )


def _pieces(base: DataFrame, s: Sequence[str], most: int, split_rows: int) -> DataFrame:
    """Percentiles of large groups; ``most`` is the size of the largest, which is cut into pieces of about a quarter of ``split_rows``."""
    once = materialize(base.groupBy("grp", "item").agg(*[F.max(a).alias(a) for a in s]), "hot_rows")
    long = once.select("grp", "item", F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.col(a).alias("v")) for i, a in enumerate(s)])).alias("x"))
    long = long.select("grp", "item", "x.s", "x.v")
    parts = int(min(1000, max(8, -(-4 * most // split_rows))))
    cuts = long.where("v IS NOT NULL").groupBy("grp", "s").agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 10_000).alias("cuts"))
    cuts = cuts.select("grp", "s", F.array_sort(F.array_distinct("cuts")).alias("cuts"))
    placed = long.join(cuts, ["grp", "s"], "left")
    # even pieces lie between two cuts, odd pieces are the values equal to a cut
    below = F.size(F.filter("cuts", lambda c: c < F.col("v")))
    placed = placed.select("grp", "item", "s", "v", (2 * below + F.array_contains("cuts", F.col("v")).cast("int")).alias("piece"))
    some = placed.where("v IS NOT NULL")
    counts = some.groupBy("grp", "s", "piece").agg(F.count("*").alias("c"))
    before = Window.partitionBy("grp", "s").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("grp", "s", "piece", "c", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"), F.sum("c").over(Window.partitionBy("grp", "s")).alias("n"))
    odd = some.where(F.col("piece") % 2 == 1).join(counts, ["grp", "s", "piece"])
    odd = odd.select("grp", "item", "s", _mid(F.col("base") + 1, F.col("c"), F.col("n")).alias("p"))
    inside = Window.partitionBy("grp", "s", "piece").orderBy("v")
    same = Window.partitionBy("grp", "s", "piece", "v")
    even = some.where(F.col("piece") % 2 == 0).withColumn("r", F.rank().over(inside)).withColumn("t", F.count("*").over(same)).join(counts, ["grp", "s", "piece"])
    even = even.select("grp", "item", "s", _mid(F.col("base") + F.col("r"), F.col("t"), F.col("n")).alias("p"))
    none = placed.where("v IS NULL").select("grp", "item", "s", F.lit(0.0).alias("p"))
    every = odd.unionByName(even).unionByName(none)
    return every.groupBy("grp", "item").agg(*[F.max(F.when(F.col("s") == i, F.col("p"))).alias(f"p{i}") for i in range(len(s))])


def leximin_rank(rows: DataFrame, group: str, item: str, scores: Sequence[str], head: int | None = None, split_rows: int = 200_000) -> DataFrame:
    """``<group>, <item>, weakest, vector, place``: place 1 is the item whose ascending percentile vector is lexicographically greatest.

    Equal vectors are ordered by the smaller item. A missing score counts as percentile 0, so it never helps. ``head`` keeps the first
    places of each group only (pruned in each partition before the shuffle); without it every item is placed, by one range-ordered sort of
    all. Defined cases: NULL group or item do not count; repeated items count once; an empty
    table gives no rows; further columns are ignored, whatever their names.
    """
    p = percentiles(rows, group, item, scores, split_rows)
    v = p.select("grp", "item", F.array_sort(F.array(*[F.col(f"p{i}") for i in range(len(scores))])).alias("vector"))
    order = [F.desc("vector"), F.col("item")]
    if head is not None:
        v = v.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy(*order))).where(F.col("place") <= head)
    else:  # sorted in ranges, whatever the sizes of the groups and the ties of their vectors
        v = numbered(v, ["grp"], order)
    return v.select(F.col("grp").alias(group), F.col("item").alias(item), F.col("vector")[0].alias("weakest"), "vector", F.col("place").cast("long").alias("place"))
