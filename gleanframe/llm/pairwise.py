"""Global ranking from pairwise comparisons: regularised logistic strengths by distributed minorisation-maximisation.

Votes are first aggregated to win counts per pair. The model says item i beats j with probability s_i / (s_i + s_j); every item also
plays ``prior`` wins and ``prior`` losses against a fixed opponent of strength 1, which keeps rarely compared items near the middle and
makes unconnected parts of a group comparable through that opponent only. Each step sets

    s_i <- (wins_i + prior) / (sum_j n_ij / (s_i + s_j) + 2 prior / (s_i + 1))

which never lowers the penalised likelihood. Standard errors of log s come from its curvature.

Every pair is a row of both its ends. The ends of a group are cut by their item into blocks of about ``block_ends`` rows; a block takes
steps on its own items, the strengths of all others held, until they stand still, and then the blocks exchange strengths. The map from
the strengths outside a block to those inside rises with every strength and less than in proportion, so repeating it converges from any
start; between exchanges a squared extrapolation shortens the way. A group of one block has nobody outside and is done after the first
exchange; all groups follow the same steps to the same tolerance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.operators.graph import components
from gleanframe.operators.ranks import numbered
from gleanframe.session import col, forget, materialize, spread


def win_counts(votes: DataFrame, group: str, winner: str, loser: str, vote: str | None) -> DataFrame:
    """``grp, a, b, wa, wb`` with a < b: how often each of a pair won. A vote delivered again counts once."""
    v = votes.select(col(group).alias("grp"), col(winner).alias("w"), col(loser).alias("l"), (col(vote) if vote else F.monotonically_increasing_id()).alias("vote"))
    v = v.dropna(subset=["grp", "w", "l"]).where("w <> l")
    if vote:
        v = v.distinct()
    one = v.select("grp", F.least("w", "l").alias("a"), F.greatest("w", "l").alias("b"), (F.col("w") < F.col("l")).cast("int").alias("x"))
    return one.groupBy("grp", "a", "b").agg(F.sum("x").cast("double").alias("wa"), F.sum(1 - F.col("x")).cast("double").alias("wb"))


def rank_comparisons(
    votes: DataFrame, group: str, winner: str, loser: str, vote: str | None = None, prior: float = 1.0, head: int | None = None, block_ends: int = 500_000,
    tolerance: float = 1e-9, rounds: int = 300,
) -> DataFrame:
    """``<group>, item, strength, std_error, wins, losses, component, components, place`` for every compared item.

    ``strength`` is log s, 0 for an average item; ``place`` orders by strength to eight decimals, then by the smaller item. ``component`` is the smallest
    item of the part of the group its votes connect it to, ``components`` the number of such parts: across parts the order rests on the
    prior alone. ``head`` keeps the first places of each group only. Steps end below ``tolerance``; a fit that is not there after
    ``rounds`` is an error.

    Defined cases: votes with a NULL group, winner or loser, and votes of an item against itself, count for nothing; repeated rows of one
    vote count once; contradicting votes all count; an empty table gives no rows; further columns are ignored.
    """
    pairs = materialize(win_counts(votes, group, winner, loser, vote), "pairs")
    kinds = dict(pairs.dtypes)
    both = pairs.select("grp", F.col("a").alias("item"), F.col("b").alias("other"), F.col("wa").alias("won"), (F.col("wa") + F.col("wb")).alias("n"))
    both = both.unionByName(pairs.select("grp", F.col("b").alias("item"), F.col("a").alias("other"), F.col("wb").alias("won"), (F.col("wa") + F.col("wb")).alias("n")))
    # at most one group of several blocks per block_ends / 2 pairs, so this table is small
    cut = pairs.groupBy("grp").agg(F.ceil(2 * F.count("*") / block_ends).cast("int").alias("blocks")).where("blocks > 1")
    cut = materialize(cut.withColumnRenamed("grp", "cut_grp"), "cut")
    place = lambda c: F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64(c), F.col("blocks"))).cast("int")
    ends = both.join(cut, F.col("grp") == F.col("cut_grp"), "left").select("grp", place("item").alias("block"), "item", "other", place("other").alias("other_block"), "won", "n")
    ends = materialize(ends, "ends")
    schema = f"grp {kinds['grp']}, block int, item {kinds['a']}, own boolean, strength double, wins double, losses double, bend double, component {kinds['a']}"

    def fit(rows: DataFrame) -> DataFrame:
        return spread(rows, "grp", "block").groupBy("grp", "block").applyInPandas(_fit_block(prior, tolerance, rounds), schema)

    alone = fit(ends.join(cut, F.col("grp") == F.col("cut_grp"), "left_anti").withColumn("start", F.lit(None).cast("double")).withColumn("outside", F.lit(None).cast("double")))
    fitted = alone.where("own")
    if not cut.isEmpty():
        fitted = fitted.unionByName(_exchange(ends.join(F.broadcast(cut), F.col("grp") == F.col("cut_grp"), "left_semi"), fit, prior, tolerance, rounds))
    fitted = materialize(fitted.withColumn("level", F.round("strength", 8)), "strengths")
    parts = fitted.select("grp", "component").distinct().groupBy(F.col("grp").alias("g2")).agg(F.count("*").alias("components"))
    order = [F.desc("level"), F.col("item")]
    if head is None:
        out = numbered(fitted, ["grp"], order)
    else:  # pruned in every partition before the exchange
        out = fitted.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy(*order))).where(F.col("place") <= head)
    out = out.join(parts, F.col("grp") == F.col("g2"))
    error = (1 / F.sqrt("bend")).alias("std_error")
    return out.select(F.col("grp").alias(group), "item", "strength", error, "wins", "losses", "component", "components", F.col("place").cast("long").alias("place"))


def stand_still(step, x: np.ndarray, tolerance: float, rounds: int) -> np.ndarray:
    """A fixed point of ``step``: three steps a round, the third from a squared extrapolation of the first two where it does no harm."""
    for _ in range(rounds):
        a = step(x)
        r = a - x
        moved = np.max(np.abs(r), initial=0.0)
        if moved < tolerance:
            return a
        b = step(a)
        v = (b - a) - r
        bend = np.linalg.norm(v)
        far = max(np.linalg.norm(r) / bend, 1.0) if bend > 0 else 1.0
        x = b
        if far > 1.0:
            c = x0 = a - r + 2 * far * r + far * far * v
            c = step(x0)
            x = c if np.max(np.abs(c - x0), initial=0.0) <= 4 * moved else b
    raise RuntimeError(f"strengths still move after {rounds} rounds")


def _fit_block(prior: float, tolerance: float, rounds: int):
    """Strengths of a block's own items from its ends; items outside hold the strength ``outside``. Further rows name the items outside
    with the block's component they touch."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        items, i = np.unique(pdf["item"].to_numpy(), return_inverse=True)
        other, won, n = pdf.other.to_numpy(), pdf.won.to_numpy(), pdf.n.to_numpy()
        inside = (pdf.block == pdf.other_block).to_numpy()
        m = len(items)
        j = np.zeros(len(pdf), dtype=np.int64)
        j[inside] = np.searchsorted(items, other[inside])
        held = np.exp(np.where(inside, 0.0, pdf.outside.fillna(0.0).to_numpy()))
        wins = np.bincount(i, won, m)
        losses = np.bincount(i, n - won, m)
        start = np.full(m, np.nan)
        start[i] = pdf.start.to_numpy(dtype=float)
        start = np.where(np.isnan(start), np.log((wins + prior) / (losses + prior)), start)

        def step(x: np.ndarray) -> np.ndarray:
            s = np.exp(x)
            load = np.bincount(i, n / (s[i] + np.where(inside, s[j], held)), m)
            return np.log((wins + prior) / (load + 2 * prior / (s + 1)))

        x = stand_still(step, start, tolerance, 50 * rounds)
        s = np.exp(x)
        o = np.where(inside, s[j], held)
        bend = np.bincount(i, n * s[i] * o / (s[i] + o) ** 2, m) + 2 * prior * s / (s + 1) ** 2
        # parts connected inside the block, over the items outside too
        outer, k = np.unique(other[~inside], return_inverse=True)
        names = np.concatenate([items, outer])
        b = j.copy()
        b[~inside] = m + k
        rank = np.argsort(np.argsort(names, kind="stable"), kind="stable")
        label = rank.copy()
        while True:
            old = label.copy()
            np.minimum.at(label, i, label[b])
            np.minimum.at(label, b, label[i])
            if (label == old).all():
                break
        smallest = names[np.argsort(rank, kind="stable")][label]
        pad = lambda v: np.concatenate([v, np.zeros(len(outer))])
        return pd.DataFrame({
            "grp": pdf.grp.iloc[0], "block": pdf.block.iloc[0], "item": names, "own": np.arange(len(names)) < m, "strength": pad(x), "wins": pad(wins), "losses": pad(losses),
            "bend": pad(bend), "component": smallest,
        })

    return run


def _exchange(ends: DataFrame, fit, prior: float, tolerance: float, rounds: int) -> DataFrame:
    """Rounds of block steps and exchanges for groups of several blocks, until no strength moves by ``tolerance`` between exchanges."""
    ends = materialize(ends, "cut_ends")
    state = ends.groupBy("grp", "item").agg(F.sum("won").alias("wins"), F.sum(F.col("n") - F.col("won")).alias("losses"))
    state = materialize(state.select("grp", "item", F.log((F.col("wins") + prior) / (F.col("losses") + prior)).alias("x")), "state")

    def sweep(at: DataFrame) -> DataFrame:
        mine = at.select("grp", "item", F.col("x").alias("start"))
        theirs = at.select("grp", F.col("item").alias("other"), F.col("x").alias("outside"))
        return materialize(fit(ends.join(mine, ["grp", "item"]).join(theirs, ["grp", "other"])), "swept")

    own = lambda swept, name: swept.where("own").select("grp", "item", F.col("strength").alias(name))
    for _ in range(rounds):
        one = sweep(state)
        went = state.join(own(one, "x1"), ["grp", "item"])
        if (went.agg(F.max(F.abs(F.col("x1") - F.col("x")))).first()[0] or 0.0) < tolerance:
            forget(state)
            edges = one.select(F.struct("grp", "item").alias("a"), F.struct("grp", F.col("component").alias("item")).alias("b"))
            whole = components(edges).select(F.col("node.grp").alias("grp"), F.col("node.item").alias("item"), F.col("component.item").alias("whole"))
            out = one.where("own").join(whole, ["grp", "item"])
            return out.select("grp", "block", "item", "own", "strength", "wins", "losses", "bend", F.col("whole").alias("component"))
        two = sweep(own(one, "x"))
        way = materialize(went.join(own(two, "x2"), ["grp", "item"]).withColumn("r", F.col("x1") - F.col("x")).withColumn("v", F.col("x2") - F.col("x1") - F.col("r")), "way")
        long = way.groupBy("grp").agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("lr"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("lv"))
        # one row per group of several blocks
        far = F.greatest(F.when(F.col("lv") > 0, F.col("lr") / F.col("lv")).otherwise(1.0), F.lit(1.0))
        x = F.col("x") + 2 * F.col("far") * F.col("r") + F.col("far") * F.col("far") * F.col("v")
        new = materialize(way.join(F.broadcast(long.select("grp", far.alias("far"))), "grp").select("grp", "item", x.alias("x")), "state")
        for old in (state, one, two, way):
            forget(old)
        state = new
    raise RuntimeError(f"strengths still move after {rounds} exchanges")
