"""Top N items within every group by partition lower bounds.

The N-th best score a partition holds of a group is a lower bound of the group's true N-th best. The largest of these bounds is joined
to the rows where they lie, rows below it are dropped, and only the survivors are exchanged and ranked. A group of millions of rows thus
sends about N rows per partition.

Only groups above ``T`` rows need a bound, where ``T`` is a hundred-thousandth of all rows, 1,000 at least: there are never more than
100,000 of them, so their bounds are broadcast at every size, and no other group has more than ``T`` rows to rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.session import col, materialize

MOST_BOUNDS = 100_000


def top_n(
    rows: DataFrame,
    group: Sequence[str | Column],
    item: str,
    score: str,
    n: int,
    where: Column | None = None,
    names: Sequence[str] | None = None,
    least_rows: int = 1000,
) -> DataFrame:
    """``<group names>, <item>, <score>, rank``: up to ``n`` distinct items of each group by score, equal scores by the smaller item.

    ``group`` may hold expressions (give ``names`` for them). Defined cases: rows with a NULL in a group column, NULL item, NULL or
    not-a-number score, or failing ``where`` do not count; an item given several times in a group counts once, with its best score;
    infinite scores rank as numbers; an empty table gives no rows; further columns are ignored, whatever their names.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    keys = [col(g) if isinstance(g, str) else g for g in group]
    names = list(names or [g for g in group if isinstance(g, str)])
    if len(names) != len(keys):
        raise ValueError("one name per group column")
    g = [f"g{i}" for i in range(len(keys))]
    base = rows if where is None else rows.where(where)
    base = base.select(*[k.alias(a) for k, a in zip(keys, g)], col(item).alias("item"), col(score).cast("double").alias("score"))
    base = base.dropna(subset=[*g, "item", "score"]).where(~F.isnan("score"))
    # the counts also tell how many rows there are
    sizes = materialize(base.groupBy(*g).agg(F.count("*").alias("rows")), "sizes")
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    large = sizes.where(F.col("rows") > max(least_rows, total // MOST_BOUNDS)).select(*[F.col(a).alias(f"b_{a}") for a in g])
    on = [F.col(a) == F.col(f"b_{a}") for a in g]
    # Spark prunes each partition to its first n ranks before the exchange (WindowGroupLimit), so this moves n rows per group and partition
    local = Window.partitionBy("part", *g).orderBy(F.desc("score"), "item")
    best = base.join(F.broadcast(large), on, "left_semi").withColumn("part", F.spark_partition_id()).withColumn("r", F.dense_rank().over(local)).where(F.col("r") <= n)
    # dense ranks count distinct (score, item); a bound holds only where they are n distinct items
    bounds = (
        best.groupBy("part", *g).agg(F.min("score").alias("low"), F.size(F.collect_set("item")).alias("k"))
        .where(F.col("k") >= n).groupBy(*g).agg(F.max("low").alias("low"))
    )
    joined = base.join(F.broadcast(bounds.select(*[F.col(a).alias(f"b_{a}") for a in g], "low")), on, "left")
    survivors = joined.where(F.col("low").isNull() | (F.col("score") >= F.col("low"))).select(*g, "item", "score")
    # partitioned by group once, for removing repeats and for the ranks
    once = survivors.repartition(*g).groupBy(*g, "item").agg(F.max("score").alias("score"))
    order = Window.partitionBy(*g).orderBy(F.desc("score"), "item")
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select(*[F.col(a).alias(x) for a, x in zip(g, names)], F.col("item").alias(item), F.col("score").alias(score), "rank")
