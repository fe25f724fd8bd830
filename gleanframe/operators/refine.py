"""Refinements of a selection: closer focus under a budget, forced items, capped picks, source checks and suffix matching."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.session import col


def close_focus_candidates(rows: DataFrame, keys: Sequence[str], moment: str, item: str, score: str, free_score: str, budget: int = 12, others: int = 2, gap: float = 1.0, free_gap: float = 0.5) -> DataFrame:
    """``keys, moment, item, place``: items whose focus is worth reading closely.

    Of each moment the leader and up to ``others`` rivals within ``gap`` of its score and ``free_gap`` of its score without focus; moments with
    no rival are left out. Moments are served by their leader's score while the group's ``budget`` holds a leader and a rival, the last
    one with as many rivals as fit. The running sum is over moments, one row each.
    """
    w = Window.partitionBy(*keys, moment).orderBy(F.desc(score), item)
    lead = lambda c: F.first(c).over(w)
    r = rows.withColumn("cf_n", F.row_number().over(w)).withColumn("cf_s", lead(score)).withColumn("cf_f", lead(free_score))
    r = r.where((F.col("cf_n") == 1) | ((F.col("cf_s") - F.col(score) <= gap) & (F.abs(F.col("cf_f") - F.col(free_score)) <= free_gap)))
    r = r.withColumn("cf_i", F.row_number().over(w)).where(F.col("cf_i") <= others + 1)
    sizes = r.groupBy(*keys, moment).agg(F.count("*").alias("cf_m"), F.max("cf_s").alias("cf_top")).where("cf_m >= 2")
    turn = Window.partitionBy(*keys).orderBy(F.desc("cf_top"), moment).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("cf_left", budget - F.coalesce(F.sum("cf_m").over(turn), F.lit(0))).where("cf_left >= 2").drop("cf_top", "cf_m")
    return r.join(sizes, [*keys, moment]).where(F.col("cf_i") <= F.col("cf_left")).select(*keys, moment, item, F.col("cf_i").alias("place"))


def refined_focus(detail: DataFrame, keys: Sequence[str], moment: str, item: str, focus: str, read: str, most: float = 1.0) -> DataFrame:
    """``item, adjustment``: the z-score of log(1 + closely read focus) in the moment, within ``most``, in place of the plain focus rank."""
    lf = F.log1p(read)
    s = detail.where(F.col(read).isNotNull()).withColumn("rf_l", lf)
    g = s.groupBy(*keys, moment).agg(F.avg("rf_l").alias("rf_m"), F.stddev_pop("rf_l").alias("rf_s"), F.count("*").alias("rf_n")).where("rf_n >= 2")
    z = F.when(F.col("rf_s") > 1e-6, (F.col("rf_l") - F.col("rf_m")) / F.col("rf_s")).otherwise(0.0)
    return s.join(g, [*keys, moment]).select(item, (F.least(F.greatest(z, F.lit(-most)), F.lit(most)) - F.col(focus)).alias("adjustment"))


def forced(items: DataFrame, path: str, wanted: DataFrame, stem: Column) -> tuple[DataFrame, DataFrame]:
    """Items whose stem (case aside) is wanted, and the wanted names that no item has. ``wanted`` has ``name``."""
    w = wanted.select(F.lower(F.regexp_replace(F.trim("name"), r"(?<=.)\.[^.]*$", "")).alias("w"), "name").where("w <> ''").distinct()
    s = items.withColumn("f_stem", F.lower(stem))
    return s.join(w.select("w").distinct(), F.col("f_stem") == F.col("w"), "left_semi").drop("f_stem"), w.join(s.select("f_stem"), F.col("w") == F.col("f_stem"), "left_anti").select("name")


def capped_picks(picks: DataFrame, keys: Sequence[str], order: str, item: str, kind: str, detail: str, exceptional: Column, per_kind: int, limit: int) -> DataFrame:
    """``keys, item, kept, reason`` of ordered picks: at most ``per_kind`` of a kind, each after the first exceptional and of another detail,
    and ``limit`` in all. A pick without kind or detail is dropped. The reason is of the first rule that fails.

    A kept pick depends on those before it; a key's picks are a ranked reply, bounded by its request, and are walked in one task.
    """
    kinds = dict(picks.dtypes)
    rows = picks.select(*keys, col(order).alias("cp_o"), col(item).alias("item"), F.lower(F.trim(F.coalesce(col(kind), F.lit("")))).alias("cp_k"), F.lower(F.trim(F.coalesce(col(detail), F.lit("")))).alias("cp_d"), F.coalesce(exceptional, F.lit(False)).alias("cp_e"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cp_o", "item"], kind="stable").drop_duplicates("item")
        held: dict[str, list[str]] = {}
        out, n = [], 0
        for k, d, e in zip(pdf.cp_k, pdf.cp_d, pdf.cp_e):
            have = held.get(k, [])
            why = "no kind" if not k else "no detail" if not d else "repeated kind" if have and (len(have) >= per_kind or not e or d in have) else "limit reached" if n >= limit else ""
            if not why:
                held.setdefault(k, []).append(d)
                n += 1
            out.append(why)
        return pd.DataFrame({**{c: pdf[c] for c in keys}, "item": pdf["item"], "kept": [not w for w in out], "reason": out})

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + f", item {kinds[item]}, kept boolean, reason string"
    return rows.groupBy(*keys).applyInPandas(run, schema)


def source_states(declared: DataFrame, found: DataFrame, key: str = "file") -> DataFrame:
    """Declared files ``key, sha256`` against files found ``key, digest``: ``missing``, ``unverified`` (no digest declared), ``changed`` or ``available``."""
    f = found.select(col(key).alias("ss_key"), F.col("digest").alias("ss_digest"))
    j = declared.join(f, col(key) == F.col("ss_key"), "left")
    state = F.when(F.col("ss_key").isNull(), "missing").when(F.coalesce("sha256", F.lit("")) == "", "unverified").when(F.col("sha256") != F.col("ss_digest"), "changed").otherwise("available")
    return j.withColumn("state", state).drop("ss_key", "ss_digest")


def match_suffix(paths: DataFrame, path: str, declared: DataFrame, file: str) -> DataFrame:
    """``path, file, matches``: absolute paths matched to the declared relative files they end with; ``file`` only where exactly one matches.

    An equi-join: a path offers each of its own suffixes at a slash, so no path is compared with files it cannot match.
    """
    parts = F.split(F.regexp_replace(col(path), "^/+", ""), "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    offers = paths.select(col(path).alias("ms_path"), tails.alias("ms_tails")).distinct().select("ms_path", F.explode("ms_tails").alias("ms_tail"))
    hits = offers.join(declared.select(col(file).alias("ms_file")).distinct(), F.col("ms_tail") == F.col("ms_file")).groupBy("ms_path").agg(F.count("*").alias("n"), F.min("ms_file").alias("f"))
    j = paths.select(col(path).alias("p")).distinct().join(hits, F.col("p") == F.col("ms_path"), "left")
    return j.select(F.col("p").alias(path), F.when(F.col("n") == 1, F.col("f")).alias(file), F.coalesce("n", F.lit(0)).alias("matches"))
