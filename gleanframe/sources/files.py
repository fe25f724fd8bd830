"""File sources: image scans with raw suppression, siblings and twins, digests, labels, reports and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanframe.functions.texts import base_name, parent, stem, suffix

# File name suffixes by kind.
JPEG = [".jpg", ".jpeg", ".jpe"]
RAW = [".orf", ".cr2", ".cr3", ".nef", ".arw", ".dng", ".raf", ".rw2", ".pef", ".srw", ".raw", ".nrw"]
OUTPUT_DIRS = ["Highlights", "AwardRoll", "Enhanced", "DxO", "_DELETE_ME_raw"]
TWIN_ORDER = ["dng", "tif", "tiff", "jpg", "jpeg"]


def listing(spark: SparkSession, root: str, recursive: bool = True, content: bool = False) -> DataFrame:
    """``path, relative, parent, name, stem, ext, size, mtime`` (and ``content``) of all files below ``root``; bytes are read only if asked for."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    files = reader.load(root)
    base = root.rstrip("/")
    path = F.regexp_replace("path", "^file:/*", "/")
    files = files.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *(["content"] if content else []))
    return files.withColumn("relative", F.substr("path", F.lit(len(base) + 2))).withColumn("parent", parent(F.col("path"))).withColumn("name", base_name(F.col("path"))).withColumn("stem", stem(F.col("path"))).withColumn("ext", suffix(F.col("path")))


def images(files: DataFrame, recursive: bool = True, exclude: Sequence[str] = (), raw: bool = True) -> DataFrame:
    """The images of a listing: JPEG and RAW suffixes in any case, no dot files; recursively neither below hidden folders nor below excluded
    names at any depth. A RAW with a JPEG of the same stem (case aside) beside it, or above its ``raw`` folder, is left out."""
    kinds = JPEG + (RAW if raw else [])
    good = files.where(F.col("ext").isin(kinds) & ~F.col("name").startswith("."))
    folders = F.slice(F.split("relative", "/"), 1, F.size(F.split("relative", "/")) - 1)
    if recursive:
        banned = F.array(*[F.lit(x) for x in [*OUTPUT_DIRS, *exclude]])
        good = good.where(~F.exists(folders, lambda d: d.startswith(".") | F.array_contains(banned, d)))
    else:
        good = good.where(F.size(folders) == 0)
    jpegs = good.where(F.col("ext").isin(JPEG)).select(F.col("parent").alias("j_parent"), F.lower("stem").alias("j_stem")).distinct()
    is_raw = F.col("ext").isin(RAW)
    keyed = good.where(is_raw).withColumn("k_parent", F.explode(F.array_distinct(F.array(F.col("parent"), F.when(F.lower(base_name(F.col("parent"))) == "raw", parent(F.col("parent"))).otherwise(F.col("parent"))))))
    hidden = keyed.join(jpegs, (F.col("k_parent") == F.col("j_parent")) & (F.lower("stem") == F.col("j_stem"))).select("path").distinct()
    return good.join(hidden, "path", "left_anti")


def raw_siblings(photos: DataFrame, files: DataFrame) -> DataFrame:
    """``path, raw``: the RAW of a photo by stem (case aside), in its folder first, then in ``RAW``, then ``raw``; first by name."""
    raws = files.where(F.col("ext").isin(RAW)).select(F.col("path").alias("raw"), F.col("name").alias("r_name"), F.lower("stem").alias("r_stem"), F.col("parent").alias("r_parent"))
    raws = raws.withColumn("home", F.when(base_name(F.col("r_parent")).isin("RAW", "raw"), parent(F.col("r_parent"))).otherwise(F.col("r_parent")))
    both = raws.withColumn("at", F.explode(F.array_distinct(F.array("home", "r_parent"))))
    rank = F.when(F.col("r_parent") == F.col("parent"), 0).when(base_name(F.col("r_parent")) == "RAW", 1).otherwise(2)
    j = photos.select("path", "parent", F.lower("stem").alias("p_stem")).join(both, (F.col("parent") == F.col("at")) & (F.col("p_stem") == F.col("r_stem")))
    w = Window.partitionBy("path").orderBy(rank, "r_name")
    return j.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("path", "raw")


def sidecars(photos: DataFrame, files: DataFrame) -> DataFrame:
    """``path, companion``: RAW, .xmp and .heic files of the same stem (its case counts) beside the photo."""
    mates = files.where(F.col("ext").isin([*RAW, ".xmp", ".heic"])).select(F.col("path").alias("companion"), F.col("parent").alias("c_parent"), F.col("stem").alias("c_stem"))
    return photos.join(mates, (F.col("parent") == F.col("c_parent")) & (F.col("stem") == F.col("c_stem")) & (F.col("path") != F.col("companion"))).select("path", "companion")


def twins(raws: DataFrame, outputs: DataFrame) -> DataFrame:
    """``path, twin``: the processed output of a raw file: its stem alone, after ``-`` or ``_``, or before ``-DxO`` or ``_DxO``; by kind, then name.

    The pattern match is an equi-join: every output offers the few stems it could belong to.
    """
    name = F.col("stem")
    ends = F.transform(F.sequence(F.lit(1), F.char_length(name)), lambda i: F.when(F.substr(name, i, F.lit(1)).isin("-", "_"), F.substr(name, i + 1)))
    starts = F.transform(F.array(F.lit("-DxO"), F.lit("_DxO")), lambda m: F.when(F.instr(name, "DxO") > 0, F.when(F.locate("-DxO", name) > 0, F.substring_index(name, "-DxO", 1)).otherwise(F.substring_index(name, "_DxO", 1))))
    offered = F.array_distinct(F.array_compact(F.concat(F.array(name), ends, starts)))
    kind = F.array_position(F.array(*[F.lit(x) for x in TWIN_ORDER]), F.regexp_replace("ext", r"^\.", ""))
    out = outputs.select(F.col("path").alias("twin"), F.col("name").alias("t_name"), kind.alias("kind"), F.explode(offered).alias("t_stem")).where("kind > 0")
    j = raws.select("path", "stem").join(out, F.col("stem") == F.col("t_stem"))
    return j.groupBy("path").agg(F.min(F.struct("kind", "t_name", "twin"))["twin"].alias("twin"))


def with_digest(files: DataFrame) -> DataFrame:
    """Adds ``digest`` (SHA-256 of the content), ``stamp`` (size and time, a cheap sign of change) and ``cache_key``."""
    at = F.unix_micros("mtime").cast("string")
    out = files.withColumn("digest", F.sha2("content", 256)).drop("content")
    return out.withColumn("stamp", F.concat_ws("|", F.col("size").cast("string"), at)).withColumn("cache_key", F.concat_ws("|", "relative", F.col("size").cast("string"), at))


def capture_times(rows: DataFrame, *columns: str, fallback: str | None = None) -> DataFrame:
    """Adds ``time``: the first of the columns that reads as ``yyyy:MM:dd HH:mm:ss`` (its first 19 characters), else the fallback."""
    tries = [F.try_to_timestamp(F.substring(c, 1, 19), F.lit("yyyy:MM:dd HH:mm:ss")) for c in columns]
    return rows.withColumn("time", F.coalesce(*tries, *([F.col(fallback).cast("timestamp")] if fallback else [])))


def label_list(spark: SparkSession, path: str, default: Sequence[str] = ()) -> DataFrame:
    """``idx, label``: one label a line; lines whose first character is ``#`` and blank lines are dropped; the default where none is left."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).where(~F.col("value").startswith("#")).select("at", F.trim("value").alias("label")).where("label <> ''")
    if lines.isEmpty():
        return spark.createDataFrame(list(enumerate(default)), "idx int, label string")
    return lines.select((F.row_number().over(Window.orderBy("at")) - 1).alias("idx"), "label")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A report CSV, every column as text. It must have unique header names with ``file`` and ``selected``, rows of equal length, and only
    0 or 1 in ``selected`` and ``auto_selected``; anything else is an error."""
    head = spark.read.text(path).first()
    names = [n.strip().strip('"').lstrip("﻿") for n in (head[0] if head else "").split(",")]
    if len(set(names)) != len(names) or not {"file", "selected"} <= set(names):
        raise ValueError("a report needs unique column names with file and selected")
    rows = spark.read.option("header", True).option("mode", "FAILFAST").option("escape", '"').option("enforceSchema", True).schema(", ".join(f"`{n}` string" for n in names)).csv(path)
    rows = rows.select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names])
    bad = F.lit(False)
    for c in ("selected", "auto_selected"):
        if c in names:
            bad = bad | ~F.col(c).isin("0", "1")
    if not rows.where(bad).isEmpty():
        raise ValueError("selected and auto_selected hold 0 or 1")
    return rows


MANIFEST = """version int, shoots array<struct<id:string, split:string, root:string, photos:array<struct<id:string, file:string, sha256:string>>,
favourites:array<string>, rejected:array<string>, acceptable:array<array<string>>, preferences:array<struct<winner:string, loser:string>>>>"""


def read_manifest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A nested JSON manifest as flat tables ``photos, favourites, rejected, acceptable, preferences``; every id must be a declared photo."""
    m = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if not m.where(~F.col("version").eqNullSafe(F.lit(1))).isEmpty():
        raise ValueError("only version 1 manifests are read")
    s = m.select(F.explode("shoots").alias("s"))
    out = {
        "photos": s.select(F.col("s.id").alias("shoot"), F.col("s.split").alias("split"), F.explode("s.photos").alias("p")).select("shoot", "split", "p.id", "p.file", "p.sha256"),
        "favourites": s.select(F.col("s.id").alias("shoot"), F.explode("s.favourites").alias("id")).distinct(),
        "rejected": s.select(F.col("s.id").alias("shoot"), F.explode("s.rejected").alias("id")).distinct(),
        "acceptable": s.select(F.col("s.id").alias("shoot"), F.posexplode("s.acceptable").alias("grp", "ids")).select("shoot", "grp", F.explode("ids").alias("id")).distinct(),
        "preferences": s.select(F.col("s.id").alias("shoot"), F.posexplode("s.preferences").alias("seq", "p")).select("shoot", "seq", "p.winner", "p.loser"),
    }
    ids = out["photos"].select("shoot", "id")
    used = out["favourites"].unionByName(out["rejected"]).unionByName(out["acceptable"].select("shoot", "id"))
    used = used.unionByName(out["preferences"].select("shoot", F.col("winner").alias("id"))).unionByName(out["preferences"].select("shoot", F.col("loser").alias("id")))
    if not used.join(ids, ["shoot", "id"], "left_anti").isEmpty():
        raise ValueError("the manifest names a photo it does not declare")
    if not out["favourites"].intersect(out["rejected"]).isEmpty():
        raise ValueError("a photo is both favourite and rejected")
    return out
