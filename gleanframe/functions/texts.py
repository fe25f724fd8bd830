"""Text, path, identity and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def suffix(path: Column) -> Column:
    """Lower-case extension with its dot; empty for none and for dot files."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+?(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def folded(text: Column) -> Column:
    """Lower case, runs of white space as one blank, none outside."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def xml_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def folder_safe(text: Column) -> Column:
    """Characters that are not letters, digits, blank, hyphen, underscore or brackets become an underscore."""
    return F.regexp_replace(text, r"[^\p{L}\p{N} \-_()]", "_")


def relative_ok(path: Column) -> Column:
    """A path that stays below its root: not empty, not absolute, without ``..``, backslashes or drive letters."""
    parts = F.split(path, "/")
    return path.isNotNull() & (path != "") & ~path.startswith("/") & ~path.contains("\\") & ~path.rlike("^[A-Za-z]:") & ~F.exists(parts, lambda p: p == "..")


def item_id(relative: Column, digest: Column) -> Column:
    """Identity of an item: its relative path and content; either change makes it another."""
    return F.sha2(F.concat(relative, F.char(F.lit(0)), digest), 256)


def anonymous(kind: str, value: Column) -> Column:
    return F.concat(F.lit(kind + "-"), F.substring(F.sha2(F.to_json(F.array(F.lit(kind), value)), 256), 1, 16))


def json_part(text: Column) -> Column:
    """From the first opening to the last closing brace; NULL without them."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


PICKS = "struct<picks:array<string>>"


def ranked_picks(text: Column, ids: Column) -> Column:
    """Ids named by a reply ``{"picks": [{"photo": n, ...} or n, ...]}``: numbers count from 1, those out of range and repeats are dropped.

    NULL where the reply holds no JSON or no picks list.
    """
    picks = F.from_json(json_part(text), PICKS)["picks"]
    number = lambda p: F.coalesce(p.try_cast("int"), F.get_json_object(p, "$.photo").try_cast("int"))
    valid = F.filter(F.transform(picks, number), lambda n: n.isNotNull() & (n >= 1) & (n <= F.size(ids)))
    return F.transform(F.array_distinct(valid), lambda n: F.element_at(ids, n))


def named_subjects(text: Column, ids: Column) -> Column:
    """Map of id to subject from ``{"subjects": [{"photo": n, "subject": "..."}]}``: strict integers, the later entry wins, 60 characters."""
    rows = F.from_json(json_part(text), "struct<subjects:array<string>>")["subjects"]
    parsed = F.transform(rows, lambda r: F.struct(F.get_json_object(r, "$.photo").alias("n"), F.get_json_object(r, "$.subject").alias("s")))
    good = F.filter(parsed, lambda x: x["n"].rlike(r"^\d+$") & (x["n"].try_cast("int") >= 1) & (x["n"].try_cast("int") <= F.size(ids)) & (F.trim(x["s"]) != ""))
    entries = F.transform(good, lambda x: F.struct(F.element_at(ids, x["n"].cast("int")).alias("key"), F.substring(folded(x["s"]), 1, 60).alias("value")))
    return F.aggregate(entries, F.expr("cast(map() as map<string,string>)"), lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, _: k != e["key"]), F.map_from_entries(F.array(e))))
