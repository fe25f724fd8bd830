"""Row-local expressions: placement, subject and exposure terms, edit benefit, budgets, boxes, angles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

GOLDEN = 0.382  # fixed value: the smaller golden section


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def valid_box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    inside = F.lit(True)
    for c in (x1, y1, x2, y2):
        inside = inside & c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c <= 1)
    return inside & (x2 > x1) & (y2 > y1)


def _bell(distance: Column, width: float) -> Column:
    return F.exp(-0.5 * F.pow(distance / F.lit(width), F.lit(2.0)))


def line_affinity(x: Column, y: Column, line: float, tolerance: float) -> Column:
    """Closeness to the guide lines at ``line`` and ``1 - line`` of both axes; strongest where two lines cross."""
    gx = _bell(F.least(F.abs(x - line), F.abs(x - (1 - line))), tolerance)
    gy = _bell(F.least(F.abs(y - line), F.abs(y - (1 - line))), tolerance)
    return (F.greatest(gx, gy) + F.sqrt(gx * gy)) / 2


def placement(x1: Column, y1: Column, x2: Column, y2: Column, tolerance: float = 0.08) -> dict[str, Column]:
    """Placement of a box in its frame; every value is NULL for a missing or invalid box.

    Affinity to thirds, golden section and centre (twice as tolerant upright), reliability (large boxes say little), and their product with
    the best of the three: alternatives, so they do not add up.
    """
    ok = valid_box(x1, y1, x2, y2)
    x, y = (x1 + x2) / 2, (y1 + y2) / 2
    thirds, golden = line_affinity(x, y, 1 / 3, tolerance), line_affinity(x, y, GOLDEN, tolerance)
    centre = _bell(x - 0.5, tolerance) * _bell(y - 0.5, 2 * tolerance)
    reliable = clip((1 - F.greatest(x2 - x1, y2 - y1)) / 0.4, 0.0, 1.0)
    out = {"thirds": thirds, "golden": golden, "centre": centre, "reliability": reliable, "placement": reliable * F.greatest(thirds, golden, centre)}
    return {k: F.when(ok, v) for k, v in out.items()}


def subject_term(subject: Column, edge: Column, weight: float = 0.4) -> Column:
    """Reward of a visible subject by the logarithm of its share, less one where a small one is cut by the frame; 0 without a subject."""
    cut = F.when(F.coalesce(edge, F.lit(False)) & (subject < 0.15), 1.0).otherwise(0.0)
    return F.when(F.coalesce(subject, F.lit(0.0)) > 0, weight * (clip(F.log10(subject / 0.01), 0.0, 1.5) - cut)).otherwise(0.0)


def exposure_penalty(clip_high: Column, clip_low: Column) -> Column:
    return 3 * F.greatest(clip_high - 0.02, F.lit(0.0)) + 2 * F.greatest(clip_low - 0.10, F.lit(0.0))


def edit_benefit(clip_high: Column, clip_low: Column, mean: Column, spread: Column | None = None, iso: Column | None = None) -> Column:
    """0 to 100, half-even: clipped highlights weigh most, then crushed shadows, dark or bright exposure, flatness, noise."""
    upto = lambda x: F.least(x, F.lit(1.0))
    score = 45 * upto(clip_high / 0.05) + 30 * upto(clip_low / 0.15)
    score = score + F.when(mean < 80, 15 * upto((80 - mean) / 40)).when(mean > 175, 10 * upto((mean - 175) / 40)).otherwise(0.0)
    if spread is not None:
        score = score + F.when(spread < 35, 10 * upto((35 - spread) / 20)).otherwise(0.0)
    if iso is not None:
        score = score + F.coalesce(20 * clip((iso - 1600) / 6400, 0.0, 1.0), F.lit(0.0))
    return F.bround(F.least(score, F.lit(100.0)), 0).cast("int")


def band(score: Column, high: int = 50, medium: int = 25) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def pick_budget(n: Column, base: int = 5, extra_per: int = 40) -> Column:
    """``base`` plus one per ``extra_per`` items, at most three times ``base``."""
    return F.least(F.lit(base) + F.floor(n / extra_per), F.lit(3 * base)).cast("long")


def shortlist_cap(n: Column, k: Column, factor: float = 3.0, least: int = 12, share: float = 0.5) -> Column:
    """The largest of a minimum, ``factor * k`` (half-even) and ``share`` of the items (rounded up)."""
    return F.greatest(F.lit(least).cast("long"), F.bround(factor * k, 0).cast("long"), F.ceil(share * n).cast("long"))


BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def best_boxes(boxes: Column, most: int = 6) -> Column:
    """Distinct valid boxes, the largest first, then by their coordinates; at most ``most``."""
    good = F.filter(boxes.cast(f"array<{BOX}>"), lambda b: b.isNotNull() & valid_box(b["x1"], b["y1"], b["x2"], b["y2"]))
    keyed = F.transform(F.array_distinct(good), lambda b: F.struct((-(b["x2"] - b["x1"]) * (b["y2"] - b["y1"])).alias("a"), b.alias("b")))
    return F.transform(F.slice(F.array_sort(keyed), 1, most), lambda k: k["b"])


def surrounding_box(boxes: Column, margin: float = 0.25) -> Column:
    """The box round all ``boxes``, widened by ``margin`` of its sides and clipped to the frame; NULL without any."""
    low = lambda f: F.array_min(F.transform(boxes, lambda b: b[f]))
    high = lambda f: F.array_max(F.transform(boxes, lambda b: b[f]))
    dx, dy = (high("x2") - low("x1")) * margin, (high("y2") - low("y1")) * margin
    out = F.struct(
        F.greatest(low("x1") - dx, F.lit(0.0)).alias("x1"), F.greatest(low("y1") - dy, F.lit(0.0)).alias("y1"),
        F.least(high("x2") + dx, F.lit(1.0)).alias("x2"), F.least(high("y2") + dy, F.lit(1.0)).alias("y2"),
    )
    return F.when(F.size(boxes) > 0, out)


def views_of(box: Column, context: Column, largest: float = 0.9) -> Column:
    """Which crops are worth taking of a subject box and its surroundings: those smaller than ``largest`` of the frame, the same one once."""
    small = lambda b: b.isNotNull() & ((b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) < largest)
    close = F.lit(True)
    for f in ("x1", "y1", "x2", "y2"):
        close = close & (F.abs(box[f] - context[f]) <= 1e-8 + 1e-5 * F.abs(box[f]))
    same = F.coalesce(close, F.lit(False))
    return F.array_compact(F.array(F.when(small(box), "subject"), F.when(small(context) & ~same, "surroundings")))


def upright(angle: Column, confidence: Column, abstain: Column, snap: Column, least: float = 2.0) -> dict[str, Column]:
    """Angle in [0, 360), confidence in [0, 1], the correction to apply and a status.

    A tilt below ``least`` degrees from a quarter turn, or any where ``snap`` holds, is corrected to the quarter turn.
    """
    a = F.pmod(angle, F.lit(360.0))
    quarter = F.bround(a / 90, 0) * 90
    fix = F.when(abstain, 0.0).when(snap | (F.abs(a - quarter) < least), F.pmod(quarter, F.lit(360.0))).otherwise(a)
    status = F.when(abstain, "abstained").when(fix != 0, "corrected").otherwise("upright")
    return {"angle": a, "confidence": clip(confidence, 0.0, 1.0), "correction": fix, "status": status}


def inscribed_crop(width: Column, height: Column, angle: Column) -> dict[str, Column]:
    """Size of the largest centred crop of the frame's ratio that has no empty corner after turning by ``angle``; two pixels are kept back
    on every edge of the source. Quarter turns keep the whole frame."""
    turns = F.bround(angle / 90, 0)
    tilt = F.radians(F.abs(angle - turns * 90))
    odd = F.pmod(turns, F.lit(2)) == 1
    w, h = F.when(odd, height).otherwise(width), F.when(odd, width).otherwise(height)
    spare = lambda x: F.greatest(x - 4, F.lit(1))
    scale = F.least(spare(w) / (w * F.cos(tilt) + h * F.sin(tilt)), spare(h) / (w * F.sin(tilt) + h * F.cos(tilt)))
    cut = lambda x: F.when(tilt == 0, x).otherwise(F.greatest(F.floor(x * scale), F.lit(1))).cast("long")
    return {"crop_width": cut(w), "crop_height": cut(h)}


def similarity_bonus(best: Column, weight: float = 0.5, low: float = 0.6, high: float = 0.9) -> Column:
    return weight * clip((best - low) / (high - low), 0.0, 1.0)


def first_matching(rules: Sequence[tuple[str, Column]], otherwise: str = "general") -> Column:
    """The name of the first rule whose condition holds."""
    out = F.lit(otherwise)
    for name, condition in reversed(rules):
        out = F.when(condition, name).otherwise(out)
    return out


def detected(boxes: Column, width: Column, height: Column, person: str = "person", sure: float = 0.5, margin: float = 3.0) -> Column:
    """What a detector's boxes (``kind, confidence, x1, y1, x2, y2`` in pixels) say of a frame: ``person`` (share of the frame of the largest
    person of at least ``sure``), ``subject`` (of the largest box of any kind), ``edge`` (that box comes within ``margin`` pixels of the
    border), ``box`` (it, in shares of the frame) and ``boxes`` (:func:`best_boxes`). No boxes give zeros, false and NULL."""
    share = lambda b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) / (width * height)
    scaled = lambda b: F.struct((b["x1"] / width).alias("x1"), (b["y1"] / height).alias("y1"), (b["x2"] / width).alias("x2"), (b["y2"] / height).alias("y2"))
    people = F.array_max(F.transform(F.filter(boxes, lambda b: (b["kind"] == person) & (b["confidence"] >= sure)), share))
    # the largest, of equal ones the first
    ranked = F.transform(boxes, lambda b, i: F.struct(share(b).alias("share"), (-i).alias("at"), b.alias("b")))
    top = F.array_max(F.transform(ranked, lambda r: F.struct(r["share"], r["at"])))
    first = F.get(boxes, -top["at"])
    some = F.coalesce(top["share"] > 0, F.lit(False))
    edge = (first["x1"] < margin) | (first["y1"] < margin) | (first["x2"] > width - margin) | (first["y2"] > height - margin)
    return F.struct(
        F.coalesce(people, F.lit(0.0)).alias("person"), F.when(some, top["share"]).otherwise(0.0).alias("subject"), F.coalesce(some & edge, F.lit(False)).alias("edge"),
        F.when(some, scaled(first)).alias("box"), best_boxes(F.transform(boxes, scaled)).alias("boxes"),
    )


def exposure_label(shortlisted: Column) -> Column:
    return F.when(shortlisted == "1", "Seen by judge").when(shortlisted == "0", "Not shown to judge").otherwise("Judge exposure unknown")


def badge(manual: Column, selected: Column) -> Column:
    return F.when(F.coalesce(manual, F.lit("")) != "", F.concat(F.lit("Manual "), manual)).when(F.coalesce(selected, F.lit(False)), "Suggested pick").otherwise("Alternative")
