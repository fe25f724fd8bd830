"""Group-normalised scores: z-scores, ranks, robust scales and rejection, as window aggregates joined back.

Statistics of a group are aggregates (map-side combined) joined to its rows, not windows, so a group that holds a large share of all rows
is neither sorted nor gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.functions.scalars import clip, exposure_penalty, subject_term
from gleanframe.operators.ranks import medians


def clean(x: Column) -> Column:
    return F.when(F.isnan(x.cast("double")), None).otherwise(x.cast("double"))


def with_stats(rows: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """The rows with aggregates of their group as further columns; NULL keys form a group of their own."""
    s = rows.groupBy(*[F.col(k).alias(f"s_{k}") for k in keys]).agg(*[a.alias(n) for n, a in stats.items()])
    on = [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in keys]
    return rows.join(s, on, "left").drop(*[f"s_{k}" for k in keys])


def z(x: Column, mean: Column, deviation: Column, least: float = 1e-6) -> Column:
    """Population z-score; 0 where the group does not vary."""
    return F.when(deviation > least, (x - mean) / deviation).when(x.isNotNull(), 0.0)


def score(rows: DataFrame, keys: Sequence[str], aesthetic_weight: float = 0.6, subject_weight: float = 0.4, editorial_weight: float = 0.15) -> DataFrame:
    """Adds ``focus_rank`` and ``score``.

    The rows need ``aesthetic, sharpness, subject_sharpness, clip_high, clip_low, subject, edge, composition_bonus`` and may have
    ``editorial``. The focus rank is the z-score of log(1 + sharpness) among the group's rows with a measured subject (of the subject's
    sharpness), or without one. Missing measurements count as the group's mean.
    """
    r = rows.withColumn("on_subject", F.col("subject_sharpness").isNotNull()).withColumn("lf", F.log1p(clean(F.coalesce("subject_sharpness", "sharpness"))))
    r = with_stats(r, keys, am=F.avg(clean(F.col("aesthetic"))), asd=F.stddev_pop(clean(F.col("aesthetic"))))
    r = with_stats(r, [*keys, "on_subject"], fm=F.avg("lf"), fsd=F.stddev_pop("lf"))
    editorial = F.lit(0.0)
    if "editorial" in rows.columns:
        r = with_stats(r, keys, em=F.avg(clean(F.col("editorial"))), esd=F.stddev_pop(clean(F.col("editorial"))))
        editorial = F.coalesce(editorial_weight * clip(z(clean(F.col("editorial")), F.col("em"), F.col("esd")) / 2, 0.0, 1.0), F.lit(0.0))
    focus = F.coalesce(z(F.col("lf"), F.col("fm"), F.col("fsd")), F.lit(0.0))
    total = (
        aesthetic_weight * F.coalesce(z(clean(F.col("aesthetic")), F.col("am"), F.col("asd")), F.lit(0.0)) + (1 - aesthetic_weight) * focus
        - exposure_penalty(F.col("clip_high"), F.col("clip_low")) + subject_term(F.col("subject"), F.col("edge"), subject_weight)
        + F.coalesce("composition_bonus", F.lit(0.0)) + editorial
    )
    drop = ["on_subject", "lf", "am", "asd", "fm", "fsd", "em", "esd"]
    return r.withColumn("focus_rank", focus).withColumn("score", total).drop(*drop)


def with_median(rows: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """The rows with the exact median of their group's known values, of groups of any size."""
    m = medians(rows.select(*keys, value), keys, value, out)
    m = m.select(*[F.col(k).alias(f"wm_{k}") for k in keys], out)
    return rows.join(m, [F.col(k).eqNullSafe(F.col(f"wm_{k}")) for k in keys], "left").drop(*[f"wm_{k}" for k in keys])


def scene_medians(rows: DataFrame, keys: Sequence[str], value: str, least: int = 3) -> DataFrame:
    """Adds ``scene_median``: the exact median of the group, 0 for groups under ``least`` rows or a negative last key."""
    r = with_median(with_stats(rows, keys, cnt=F.count(F.lit(1))), keys, value, "med")
    return r.withColumn("scene_median", F.when((F.col(keys[-1]) >= 0) & (F.col("cnt") >= least), F.coalesce("med", F.lit(0.0))).otherwise(0.0)).drop("med", "cnt")


def reject_reason(label: Column, sharpness: Column, scene_median: Column, clip_high: Column, clip_low: Column, skip: Sequence[str], floor: float = 20.0, ratio: float = 0.15) -> Column:
    """``label``, ``blurry`` (below the floor or a share of its scene's median), ``exposure`` or empty; the first that holds."""
    blurry = (sharpness < floor) | (sharpness < ratio * scene_median)
    return F.when(label.isin(list(skip)), "label").when(blurry, "blurry").when((clip_high > 0.4) | (clip_low > 0.6), "exposure").otherwise("")


def mid_rank(rows: DataFrame, keys: Sequence[str], value: str, out: str = "mid_rank") -> DataFrame:
    """Adds the tied percentile of ``value`` in its group, scaled to [-1, 1]; 0 alone.

    Counts of distinct values are aggregated first, so ties of any number cost one row each in the running sum.
    """
    counts = rows.groupBy(*keys, F.col(value).alias("mv")).agg(F.count("*").alias("ties"))
    w = Window.partitionBy(*keys).orderBy("mv").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("below", F.coalesce(F.sum("ties").over(w), F.lit(0))).withColumn("all", F.sum("ties").over(Window.partitionBy(*keys)))
    rank = F.col("below") + (F.col("ties") - 1) / 2
    counts = counts.select(*[F.col(k).alias(f"k_{k}") for k in keys], "mv", F.when(F.col("all") > 1, 2 * rank / (F.col("all") - 1) - 1).otherwise(0.0).alias(out))
    on = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys] + [F.col(value).eqNullSafe(F.col("mv"))]
    return rows.join(counts, on).drop("mv", *[f"k_{k}" for k in keys])


def robust_quality(rows: DataFrame, keys: Sequence[str], value: str, out: str = "quality") -> DataFrame:
    """Adds the logistic of (value - median) over the robust scale max(1.4826 MAD, 1), clipped at 30."""
    r = with_median(rows, keys, value, "rq_med").withColumn("rq_dev", F.abs(F.col(value) - F.col("rq_med")))
    r = with_median(r, keys, "rq_dev", "rq_mad")
    x = clip((F.col(value) - F.col("rq_med")) / F.greatest(1.4826 * F.col("rq_mad"), F.lit(1.0)), -30.0, 30.0)
    return r.withColumn(out, 1 / (1 + F.exp(-x))).drop("rq_med", "rq_dev", "rq_mad")


def person_override(label: Column, prob: Column, person: Column, area: float = 0.02, agree: float = 0.2, trust: float = 0.5, people: str = "people") -> tuple[Column, Column]:
    """Label and probability with a person of at least ``area`` taken for the subject: where the label is at least ``agree`` probable or unknown,
    or the person fills ``trust`` of the frame."""
    hit = (F.coalesce(person, F.lit(0.0)) >= area) & (prob.isNull() | F.lit(agree <= 0) | (prob >= agree) | (person >= trust))
    return F.when(hit, people).otherwise(label), F.when(hit, F.greatest(prob, person)).otherwise(prob)
