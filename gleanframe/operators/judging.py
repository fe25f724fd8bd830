"""Rounds of judgment: a plug-in ranker sees batches of bounded size, its answers are checked, and winners meet until one pool is left."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanframe.operators.duplicates import FIELDS, Rule, Views, duplicate_components
from gleanframe.operators.similarity import exact_twins
from gleanframe.session import col, materialize

Ranker = Callable[[pd.DataFrame, int, bool], Sequence]
FAILED = "(judge failed, by score)"


def by_score(batch: pd.DataFrame, k: int, final: bool) -> list:
    """The ranker without a model: the ``k`` best by score, then the smaller item."""
    return batch.sort_values(["score", "item"], ascending=[False, True], kind="stable")["item"].head(k).tolist()


def _without_copies(pdf: pd.DataFrame, k: int, rule: Rule) -> list:
    """The ``k`` best by score of which none duplicates another."""
    pdf = pdf.sort_values(["score", "item"], ascending=[False, True], kind="stable").reset_index(drop=True)
    v, taken = Views(pdf), []
    for i in range(len(pdf)):
        if len(taken) < k and not (taken and v.duplicates([i], v, taken, rule).any()):
            taken.append(i)
    return pdf["item"].to_numpy()[taken].tolist()


def judged_round(rows: DataFrame, keys: Sequence[str], k: str, ranker: Ranker, final: bool, rule: Rule = Rule(), attempts: int = 3, pause: float = 0.0, most_failures: int = 3) -> DataFrame:
    """``keys, batch, item, place, reason``: of every batch of ``rows`` (``keys, batch, item, score, bucket`` and a column ``k``) the ranker's picks.

    ``place`` is NULL for rows not picked. Answers are checked: items not of the batch and repeats are left out, and ``k`` is the most. A
    ranker that raises is asked again up to ``attempts`` times, longer waited for each time; then the batch is decided by score without near
    copies. ``most_failures`` failed batches in a row, in the order of keys and batches, end the run with an error.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + f", batch int, item {kinds['item']}, place int, reason string, failed boolean"

    def judge(pdf: pd.DataFrame) -> tuple[list, bool]:
        most, answer = min(int(pdf[k].iloc[0]), len(pdf)), None
        for n in range(attempts):
            try:
                answer = list(ranker(pdf, most, final))
                break
            except Exception:  # noqa: BLE001 - whatever a plug-in raises is a failed attempt
                time.sleep(pause * (n + 1))
        known = set(pdf["item"])
        return list(dict.fromkeys(i for i in (_without_copies(pdf, most, rule) if answer is None else answer) if i in known))[:most], answer is None

    lost = "Not selected in final comparison" if final else "Not selected by judge"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", kind="stable").drop_duplicates([*keys, "batch", "item"]).reset_index(drop=True)
        place, reason, bad = np.full(len(pdf), None, dtype=object), np.full(len(pdf), lost, dtype=object), np.zeros(len(pdf), dtype=bool)
        for _, at in pdf.groupby([*keys, "batch"], sort=False, dropna=False).indices.items():
            picks, failed = judge(pdf.iloc[at].reset_index(drop=True))
            rank = {i: n + 1 for n, i in enumerate(picks)}
            for p, i in zip(at, pdf["item"].to_numpy()[at]):
                if i in rank:
                    place[p], reason[p] = rank[i], FAILED if failed else ""
            bad[at] = failed
        return pd.DataFrame({**{c: pdf[c] for c in keys}, "batch": pdf.batch, "item": pdf["item"], "place": pd.array(place, dtype="Int32"), "reason": reason, "failed": bad})

    # many batches a task, each of bounded size: a call for every batch would cost more than most judgments
    slots = max(1, -(-rows.select(*keys, "batch").distinct().count() // 200))
    cut = rows.withColumn("slot", F.pmod(F.xxhash64(*keys, "batch"), F.lit(slots)))
    out = materialize(cut.repartition(min(slots, 20_000), "slot").groupBy("slot").applyInPandas(run, schema), "judged")
    failed = out.groupBy(*keys, "batch").agg(F.max("failed").alias("failed"))
    if not failed.where("failed").isEmpty():
        bad, streak = 0, 0
        for r in failed.orderBy(*keys, "batch").toLocalIterator():  # one flag a batch, not kept
            streak = streak + 1 if r["failed"] else 0
            bad = max(bad, streak)
            if bad >= most_failures:
                raise RuntimeError(f"the judge failed {bad} times in a row")
    return out.drop("failed")


def _merges(pools: DataFrame, keys: Sequence[str], chunk: int) -> DataFrame:
    """``keys, batch, merged``: pools of a group joined in order while a batch holds them; one small row a pool."""
    kinds = dict(pools.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("batch", kind="stable").reset_index(drop=True)
        merged = np.zeros(len(pdf), dtype=np.int32)
        n, k = pdf.n.to_numpy(), pdf.k.to_numpy()
        for group in pdf.groupby(list(keys), sort=False, dropna=False).indices.values():
            at, held = 0, 0
            for p in group:
                if held and held + n[p] > max(chunk, 2 * int(k[p])):
                    at, held = at + 1, 0
                held += n[p]
                merged[p] = at
        return pd.DataFrame({**{c: pdf[c] for c in keys}, "batch": pdf.batch, "merged": merged})

    n = int(pools.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", batch int, merged int"
    return pools.withColumn("slot", F.pmod(F.xxhash64(*keys), F.lit(n))).groupBy("slot").applyInPandas(run, schema)


def judged_tournament(rows: DataFrame, keys: Sequence[str], k: str, ranker: Ranker = by_score, chunk: int = 24, rule: Rule = Rule(), first_final: bool = False, **how) -> DataFrame:
    """``keys, item, place, reason`` of every row of ``rows`` (``keys, batch, item, score, bucket, k``): the winners of the last pool have a place.

    Every batch may send on as many as the group may pick, so with one consistent ranker the winners are the best of the group, wherever they
    stood. Pools are merged in order while ``max(chunk, 2 k)`` holds them; each round has fewer pools.
    """
    rows = materialize(rows, "judging")
    got = judged_round(rows, keys, k, ranker, first_final, rule, **how)
    lost = got.where("place IS NULL")
    pools = got.where("place IS NOT NULL")
    while True:
        sizes = pools.groupBy(*keys, "batch").agg(F.count("*").alias("n")).join(rows.groupBy(*keys).agg(F.max(k).alias("k")), list(keys))
        merges = materialize(_merges(sizes, keys, chunk), "merges")
        several = merges.groupBy(*keys, "merged").agg(F.count("*").alias("pools"))
        if several.where("pools > 1").isEmpty():
            out = pools.unionByName(lost).select(*keys, "item", "place", "reason")
            return out
        moved = pools.join(merges, [*keys, "batch"]).join(several, [*keys, "merged"])
        still = moved.where("pools = 1").select(*keys, F.col("merged").alias("batch"), "item", "place", "reason")
        meet = moved.where("pools > 1").select(*keys, F.col("merged").alias("batch"), "item", F.col("reason").alias("before"))
        again = judged_round(meet.join(rows.drop("batch"), [*keys, "item"]), keys, k, ranker, True, rule, **how)
        lost = lost.unionByName(again.where("place IS NULL"))
        pools = materialize(still.unionByName(again.where("place IS NOT NULL")), "pools")


def reconcile(chosen: DataFrame, keys: Sequence[str], item: str, bucket: str, rule: Rule, ranker: Ranker = by_score, chunk: int = 24, **how) -> DataFrame:
    """``keys, item, kept, reason`` of the picks of a day over all buckets: copies fall to the best of them, and picks of different buckets that
    look alike are judged once more, component by component; all of a component may stay."""
    chosen = materialize(chosen, "chosen")
    twins = exact_twins(chosen, item, "digest", "score", keys)
    folded = twins.where(F.col(item) != F.col("keeper")).select(*keys, item, F.lit(False).alias("kept"), F.concat(F.lit("= identical copy of "), F.regexp_extract("keeper", r"([^/]*)$", 1)).alias("reason"))
    single = chosen.join(folded.select(*keys, item), [*keys, item], "left_anti")
    parts = duplicate_components(single, keys, item, bucket, rule)
    groups = parts.groupBy(*keys, "component").agg(F.count("*").alias("k")).where("k > 1")
    fields = [c for c in FIELDS if c in chosen.columns]
    rows = single.join(parts, [*keys, item]).join(groups, [*keys, "component"]).select(*keys, "component", col(item).alias("item"), "score", col(bucket).alias("bucket"), "k", *[f for f in fields if f != bucket])
    # batches of a component in order of its items
    from gleanframe.operators.selection import balanced_chunks

    rows = balanced_chunks(rows, [*keys, "component"], [F.col("item")], chunk).withColumnRenamed("chunk", "batch")
    judged = judged_tournament(rows, [*keys, "component"], "k", ranker, chunk, rule, True, **how)
    out = judged.select(*keys, F.col("item").alias(item), F.col("place").isNotNull().alias("kept"), "reason")
    rest = single.join(out.select(*keys, item), [*keys, item], "left_anti").select(*keys, item, F.lit(True).alias("kept"), F.lit("").alias("reason"))
    return folded.unionByName(out).unionByName(rest)


def checked_picks(picks: DataFrame, keys: Sequence[str], order: str, item: str, fits: Column, kind: str, detail: str, special: Column, why: str, limit: int, curate: bool = True) -> DataFrame:
    """``keys, item, kept, reason`` of a ranked reply: the rules of a roll in order, of which the first that fails gives the reason.

    A pick needs a fitting subject with a kind, and a detail; curated, a kind comes again once only, if special with a reason and of another
    detail; and ``limit`` holds in all. A key's picks are one reply, bounded by its request.
    """
    kinds = dict(picks.dtypes)
    text = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+", " ")))
    rows = picks.select(*keys, col(order).alias("o"), col(item).alias("item"), text(kind).alias("kind"), text(detail).alias("detail"), F.coalesce(fits, F.lit(False)).alias("fits"), (F.coalesce(special, F.lit(False)) & (text(why) != "")).alias("special"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["o", "item"], kind="stable").drop_duplicates("item")
        shown: dict[str, list[str]] = {}
        out, n = [], 0
        for fits, kind, detail, special in zip(pdf.fits, pdf.kind, pdf.detail, pdf.special):
            had = shown.get(kind, [])
            if not fits or not kind:
                out.append("not a fitting subject")
            elif not detail:
                out.append("no visible moment")
            elif curate and had and (len(had) > 1 or not special or detail in had):
                out.append("repeated without a distinct exceptional moment")
            elif n >= limit:
                out.append("collection budget filled")
            else:
                out.append("")
                n += 1
                shown.setdefault(kind, []).append(detail)
        return pd.DataFrame({**{c: pdf[c] for c in keys}, "item": pdf["item"], "kept": [not r for r in out], "reason": out})

    return rows.groupBy(*keys).applyInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + f", item {kinds[item]}, kept boolean, reason string").withColumnRenamed("item", item)
