"""Report rows and sinks: formatted projections, CSV, sidecar texts, folder layouts and collision-free names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.functions.texts import folder_safe, xml_escaped
from gleanframe.session import col


def fixed(x: Column, digits: int) -> Column:
    """A number as text with fixed decimals (half-even on the binary value), empty for NULL and not a number."""
    text = F.replace(F.format_number(x.cast("double"), digits), F.lit(","), F.lit(""))
    return F.when(x.isNull() | F.isnan(x.cast("double")), "").otherwise(text)


def flag(x: Column) -> Column:
    return F.when(x, "1").otherwise("0")


def report(rows: DataFrame, formats: Sequence[tuple[str, Column]], order: Sequence[Column]) -> DataFrame:
    """The report: every column as text in the stated order of columns and rows."""
    return rows.orderBy(*order).select(*[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in formats])


def write_csv(rows: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; ``single`` gathers to one file and is meant for reports of bounded size only."""
    (rows.coalesce(1) if single else rows).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def sidecar(rating: Column, keywords: Column, description: Column, label: Column) -> Column:
    """An XMP text: rating, keywords, description and label, escaped; empty parts are left out."""
    words = F.concat_ws("", F.transform(keywords, lambda k: F.concat(F.lit("<rdf:li>"), xml_escaped(k), F.lit("</rdf:li>"))))
    return F.concat(
        F.lit('<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmp:Rating="'),
        rating.cast("string"), F.lit('"'), F.when(label != "", F.concat(F.lit(' xmp:Label="'), xml_escaped(label), F.lit('"'))).otherwise(""), F.lit(">"),
        F.when(F.size(keywords) > 0, F.concat(F.lit("<dc:subject><rdf:Bag>"), words, F.lit("</rdf:Bag></dc:subject>"))).otherwise(""),
        F.when(description != "", F.concat(F.lit('<dc:description><rdf:Alt><rdf:li xml:lang="x-default">'), xml_escaped(description), F.lit("</rdf:li></rdf:Alt></dc:description>"))).otherwise(""),
        F.lit("</rdf:Description></rdf:RDF></x:xmpmeta>"),
    )


def rating(selected: Column, rejected: Column, shortlisted: Column) -> Column:
    """Stars: 5 picked, 1 rejected, 3 shortlisted, else 0."""
    return F.when(selected, 5).when(rejected, 1).when(shortlisted, 3).otherwise(0)


def folder(layout: str, day: Column, label: Column) -> Column:
    """Target folder of a layout: ``flat``, ``label``, ``day`` or ``day-label``."""
    safe = folder_safe(label)
    return {"flat": F.lit(""), "label": safe, "day": day, "day-label": F.concat_ws("/", day, safe)}[layout]


def unique_names(rows: DataFrame, keys: Sequence[str], name: str, order: Sequence[Column], out: str = "target") -> DataFrame:
    """Adds a name that is unique in its folder, case aside: the first keeps its own, later ones get ``_2``, ``_3``, ... before the suffix."""
    w = Window.partitionBy(*keys, F.lower(col(name))).orderBy(*order)
    r = rows.withColumn("nth", F.row_number().over(w))
    stem, ext = F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(name, r".(\.[^.]*)$", 1)
    return r.withColumn(out, F.when(F.col("nth") == 1, col(name)).otherwise(F.concat(stem, F.lit("_"), F.col("nth").cast("string"), ext))).drop("nth")


# The columns of the report in order, each with its form: t text, f flag, i whole number, s time, or digits after the point.
COLUMNS = """file:t datetime:s day:t label:t label_prob:2 person:3 subject:3 edge:f scene:i sharpness:1 clip_low:3 clip_high:3 aesthetic:2 score:3 reject:t shortlisted:f selected:f judge_reason:t iso:i
edit_score:i edit_benefit:t edit_why:t preset:t relative_file:t source:t subject_sharpness:2 decision:t rule_of_thirds:4 golden_ratio:4 center_composition:4 placement_reliability:4 composition_score:4
composition_bonus:4 editorial_light:4 editorial_composition:4 editorial_subject:4 editorial_moment:4 editorial_score:4 editorial_bonus:4 moment:i moment_novelty:4 subject_embedding:f focus_rank:4
detail_focus:4 refined_focus_adjustment:4 focus_refinement:t preselection_reason:t burst:i subject_box_count:i interaction_embedding:f burst_expression:4 burst_interaction:4 burst_gesture:4 judge_label:t
award_rank:i award_moment:t award_special_moment:f award_exceptional_reason:t photo_id:t photo_sha256:t auto_selected:f auto_decision:t manual_decision:t manual_reason:t review_status:t review_revision:i"""
FORMS = [tuple(c.split(":")) for c in COLUMNS.split()]


def whole_report(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The report of 66 columns as text, in order of rows; columns the rows do not have are empty, and so are missing numbers."""
    def form(name: str, kind: str) -> Column:
        if name not in rows.columns:
            return F.lit("")
        c = col(name)
        if kind == "f":
            return flag(F.coalesce(c.cast("boolean"), F.lit(False)))
        if kind == "s":
            return F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
        return fixed(c, int(kind)) if kind.isdigit() else F.coalesce(c.cast("string"), F.lit(""))

    return rows.orderBy(*order).select(*[form(n, k).alias(n) for n, k in FORMS])


def keywords(tool: str, label: Column, selected: Column, preset: Column, band: Column) -> Column:
    """The keyword list of a sidecar: the tool, the label below it, and of picks a mark, the preset and the benefit of an edit."""
    chosen = F.coalesce(selected, F.lit(False))
    of = lambda head, c: F.when(chosen & (F.coalesce(c, F.lit("")) != ""), F.concat(F.lit(f"{tool}|{head}"), c))
    return F.array_compact(F.array(F.lit(tool), F.concat(F.lit(f"{tool}|"), F.coalesce(label, F.lit(""))), F.when(chosen, f"{tool}|Pick"), of("Preset|", preset), of("RAW edit ", band)))


def write_sidecars(rows: DataFrame, folder: str, name: str, text: str, overwrite: bool = False) -> DataFrame:
    """Writes ``text`` of every row to ``folder/name`` and returns ``name, written``: a file that is there stays, unless told otherwise.

    Files are written whole beside their place and then moved to it. ``folder`` is one that all executors share.
    """
    import os

    def run(batches):
        import pandas as pd

        for b in batches:
            done = []
            for n, t in zip(b.name, b.text):
                at = os.path.join(folder, n)
                new = overwrite or not os.path.exists(at)
                if new:
                    os.makedirs(os.path.dirname(at), exist_ok=True)
                    with open(f"{at}.{os.getpid()}.part", "w", encoding="utf-8") as f:
                        f.write(t)
                    os.replace(f"{at}.{os.getpid()}.part", at)
                done.append(new)
            yield pd.DataFrame({"name": b.name, "written": done})

    return rows.select(col(name).alias("name"), col(text).alias("text")).mapInPandas(run, "name string, written boolean")
