"""Vector expressions over array columns, JVM-side. All are NULL where an input is NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: as a lambda variable it is not copied to each of its mentions."""
    return F.transform(F.array(value), body)[0]


def as_double(v: Column) -> Column:
    """float32 arrays are widened before any arithmetic."""
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products in array order; NULL where the lengths differ."""
    total = F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column, epsilon: float = 0.0) -> Column:
    """Scaled to length one; a zero vector gives NULL unless ``epsilon`` keeps the division finite."""
    return let(as_double(v), lambda a: let(norm(a) + F.lit(epsilon), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n))))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def usable(v: Column, dims: int) -> Column:
    """The vector where it has ``dims`` finite values that are not all zero, else NULL."""
    finite = lambda d: F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return let(as_double(v), lambda d: F.when((F.size(d) == dims) & finite(d) & F.exists(d, lambda x: x != 0), d))


def softmax_weights(scores: Column, scale: float = 100.0) -> Column:
    """exp(scale * (s - max)) over an array of scores: the numerators of a softmax, safe from overflow."""
    top = F.array_max(scores)
    return F.transform(scores, lambda s: F.exp(F.lit(scale) * (s - top)))


def with_unit(rows: DataFrame, vector: str, out: str, dims: int) -> DataFrame:
    """Adds ``out``: the vector at length one, NULL where it is unusable."""
    return rows.withColumn(out, normalize(usable(F.col(vector), dims)))


def mean_vector(rows: DataFrame, keys: Sequence[str], vector: str, dims: int, out: str = "mean", unit: bool = True, epsilon: float = 1e-9) -> DataFrame:
    """Element-wise mean of each group, combined map-side by one vector aggregate, so no group is ever gathered.

    With ``unit`` the mean is scaled to length one (plus ``epsilon``). Rows whose vector is unusable are left out; a group without any
    gives no row.
    """
    v = rows.select(*keys, usable(F.col(vector), dims).alias("_v")).where("_v IS NOT NULL")
    means = v.groupBy(*keys).agg(vector_to_array(Summarizer.mean(array_to_vector("_v"))).alias("_m"))
    if not unit:
        return means.withColumnRenamed("_m", out)
    return means.withColumn("_n", norm(F.col("_m")) + F.lit(epsilon)).select(*keys, F.transform("_m", lambda x: x / F.col("_n")).alias(out))


def margins(v: Column, pairs: Sequence[tuple[str, Sequence[float], Sequence[float]]]) -> dict[str, Column]:
    """For each named pair of stated vectors the difference of the dot products with the first and the second, and ``mean_margin``."""
    lit = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    out = {name: dot(v, lit([a - b for a, b in zip(good, bad)])) for name, good, bad in pairs}
    total = None
    for c in out.values():
        total = c if total is None else total + c
    return {**out, "mean_margin": total / len(out)} if out else {}


def best_margin(views: Sequence[Column], good: Sequence[float], bad: Sequence[float]) -> Column:
    """The largest margin over the views that are known; NULL where none is."""
    each = [margins(v, [("m", good, bad)])["m"] for v in views]
    return F.greatest(*each) if len(each) > 1 else each[0]
