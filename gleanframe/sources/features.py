"""Versioned, incremental feature tables: what is already computed, what is missing, and atomic replacement."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def load(spark: SparkSession, path: str, schema: str, detector: str = "", readable: Sequence[int] = (VERSION,)) -> DataFrame:
    """The feature table at ``path``; rows of another version or detector, or no table at all, count as not computed.

    Columns missing in older files are NULL (``mergeSchema``); NaN-only vectors become NULL.
    """
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    table = spark.read.option("mergeSchema", True).parquet(path)
    ok = F.col("schema_version").isin(list(readable)) & (F.col("detector") == detector)
    want = spark.createDataFrame([], schema).schema
    cols = []
    for f in want:
        c = F.col(f.name) if f.name in table.columns else F.lit(None)
        if f.dataType.typeName() == "array" and f.dataType.elementType.typeName() in ("float", "double"):
            c = F.when(F.forall(c.cast(f.dataType), lambda x: F.isnan(x)), None).otherwise(c)
        cols.append(c.cast(f.dataType).alias(f.name))
    return table.where(ok).select(*cols)


def todo(items: DataFrame, features: DataFrame, key: str = "cache_key", needed: Sequence[str] = ()) -> DataFrame:
    """Items without features, and items of which a needed column is NULL: ``key, reason`` (``new`` or the column to fill in)."""
    have = features.select(F.col(key).alias("f_key"), *[F.col(c).isNull().alias(f"no_{c}") for c in needed])
    new = items.join(have, F.col(key) == F.col("f_key"), "left_anti").select(key, F.lit("new").alias("reason"))
    for c in needed:
        part = items.join(have.where(F.col(f"no_{c}")), F.col(key) == F.col("f_key"), "left_semi").select(key, F.lit(c).alias("reason"))
        new = new.unionByName(part)
    return new


def merge(old: DataFrame, new: DataFrame, key: str = "cache_key") -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def save(features: DataFrame, path: str, detector: str = "") -> None:
    """Write beside the table, then swap by renaming, so that readers see the old table or the new one and a lost job leaves the old."""
    spark = features.sparkSession
    stage, old = f"{path}.stage-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    features.withColumn("schema_version", F.lit(VERSION)).withColumn("detector", F.lit(detector)).write.parquet(stage)
    P = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = P(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(P(path))
    if had and not fs.rename(P(path), P(old)):
        raise OSError(f"cannot set aside {path}")
    if not fs.rename(P(stage), P(path)):
        if had:
            fs.rename(P(old), P(path))
        raise OSError(f"cannot replace {path}")
    if had:
        fs.delete(P(old), True)
