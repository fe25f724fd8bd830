"""Filling fixed-capacity containers: vector bin packing by the dot-product heuristic.

Every piece has three sizes: tokens, segments (1) and loss-bearing tokens (those after its first line, the whole text of a single line).
A container takes pieces while all three limits hold. It is filled by repeatedly taking the fitting piece whose sizes have the largest
weighted dot product with the room left, so large pieces come first and the last gap is closed by the piece that fits it best.

Texts over the capacity are split into full containers and one remainder; nothing else is split. Where a piece of a container's tokens
could hold more loss-bearing tokens than a container may, pieces are cut at that number. Items are spread by a hash over blocks
of about ``block_items`` pieces, each packed in one task: a block holds a bounded number of items, whatever their source, and can waste
space only in its last containers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.llm import tokens as tk
from gleanframe.session import col, materialize

OUT = "id {kind}, piece int, pieces int, start long, tokens long, loss long, container long"


def fill(size: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container number of each row of ``size`` (n x 3, each within ``limits``); rows of equal size are interchangeable, first come first."""
    n = len(size)
    out = np.full(n, -1, dtype=np.int64)
    if not n:
        return out
    kinds, kind_of = np.unique(size, axis=0, return_inverse=True)
    kind_of = kind_of.ravel()
    order = np.argsort(kind_of, kind="stable")
    left = np.bincount(kind_of, minlength=len(kinds))
    at = np.concatenate([[0], np.cumsum(left)[:-1]])
    # weights: how scarce each limit is over all items
    demand = size.sum(0) / limits
    weight = demand / max(demand.sum(), 1e-12)
    scaled = kinds / limits
    number, placed = 0, 0
    live = np.arange(len(kinds))
    while placed < n:
        room = limits.astype(np.float64).copy()
        live = live[left[live] > 0]
        fits = live
        while True:
            fits = fits[(left[fits] > 0) & (kinds[fits] <= room).all(1)]
            if not len(fits):
                break
            k = fits[np.argmax(scaled[fits] @ (weight * room / limits))]
            out[order[at[k]]] = number
            at[k] += 1
            left[k] -= 1
            room -= kinds[k]
            placed += 1
        number += 1
    return out


def pack(
    docs: DataFrame, item: str, text: str, capacity: int = 2048, max_segments: int = 64, max_loss: int | None = None, block_items: int = 10_000, tokenizer: str = tk.RANKS
) -> DataFrame:
    """``<item>, piece, pieces, start, tokens, loss, container``: one row per piece; ``start`` is its first token in the text.

    Defined cases: a NULL item does not count; a NULL or empty text is one piece of no tokens and takes one segment; an item given again
    counts once (the longest text); a text of any length is tokenized whole; equal sizes are placed in order of the item; an empty table
    gives no rows; further columns are ignored, whatever their names.
    """
    if capacity < 1 or max_segments < 1:
        raise ValueError("capacity and max_segments must be positive")
    limit = np.array([capacity, max_segments, max_loss or capacity], dtype=np.int64)
    rows = docs.select(col(item).alias("id"), col(text).cast("string").alias("text")).where(F.col("id").isNotNull())
    kind = dict(rows.dtypes)["id"]

    def measure(batches):
        for b in batches:
            first = b.text.map(lambda t: None if t is None or "\n" not in t else t[: t.index("\n") + 1])
            n = tk.counts(b.text, tokenizer)
            yield pd.DataFrame({"id": b.id, "tokens": n, "loss": [x - y for x, y in zip(n, tk.counts(first, tokenizer))]})

    sized = materialize(rows.mapInPandas(measure, f"id {kind}, tokens long, loss long"), "sizes")
    # pieces of full containers need no packing; only the others fill a block
    loose = sized.where(F.col("tokens") % capacity != 0).count() + sized.where("tokens = 0").count()
    blocks = max(1, -(-loose // block_items))
    spread = sized.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf.block.iloc[0])
        p = pdf.sort_values(["id", "tokens", "loss"], ascending=[True, False, False], kind="stable").drop_duplicates("id")
        n, loss = p.tokens.to_numpy(), np.maximum(p.loss.to_numpy(), 0)
        unit = np.where(loss > limit[2], min(capacity, limit[2]), capacity)
        pieces = np.maximum(1, -(-n // unit))
        i = np.repeat(np.arange(len(p)), pieces)
        piece = np.arange(len(i)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * unit[i]
        size = np.minimum(n[i] - start, unit[i])
        # loss-bearing tokens are the last ones of a text
        bears = np.maximum(start + size - np.maximum(start, (n - loss)[i]), 0)
        container = np.empty(len(i), dtype=np.int64)
        full = size == capacity
        container[full] = np.arange(full.sum())
        v = np.stack([size, np.ones_like(size), bears], 1)
        container[~full] = full.sum() + fill(v[~full], limit)
        return pd.DataFrame({"id": p.id.to_numpy()[i], "piece": piece, "pieces": pieces[i], "start": start, "tokens": size, "loss": bears, "container": (b << 32) + container})

    # an explicit number keeps the small shuffle from being coalesced into few long tasks
    out = spread.repartition(min(blocks, 20_000), "block").groupBy("block").applyInPandas(block, OUT.format(kind=kind))
    return out.withColumnRenamed("id", item)
