"""Files, feature tables, reports, manifests and images."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanframe.functions import images
from gleanframe.sources import features, files


def tree(root, names):
    for n in names:
        p = root / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(n.encode())
    return files.listing(root=str(root), spark=tree.spark)


@pytest.fixture(autouse=True)
def _spark(spark):
    tree.spark = spark


def names(df, c="path"):
    return sorted(r[c].rsplit("/", 1)[1] for r in df.collect())


def test_scan_keeps_one_of_each_shot(spark, tmp_path):
    ls = tree(tmp_path, ["a.JPG", "a.ORF", "b.orf", "c.jpg", "d.CR3", ".hidden.jpg", "notes.txt", "raw/c.nef", "x/Highlights/z.jpg", "x/y.jpg", "skip/q.jpg"])
    assert names(files.images(ls, exclude=["skip"])) == ["a.JPG", "b.orf", "c.jpg", "d.CR3", "y.jpg"]
    assert names(files.images(ls, recursive=False)) == ["a.JPG", "b.orf", "c.jpg", "d.CR3"]
    shots = files.images(ls, exclude=["skip"])
    assert {(r["path"].rsplit("/", 1)[1], r["raw"].rsplit("/", 1)[1]) for r in files.raw_siblings(shots, ls).collect()} >= {("a.JPG", "a.ORF"), ("c.jpg", "c.nef")}


def test_twins_by_pattern(spark, tmp_path):
    raws = tree(tmp_path / "r", ["P1.ORF", "P2.ORF", "P3.ORF", "P4.ORF"])
    outs = tree(tmp_path / "o", ["P1.jpg", "P1.dng", "x-P2.tif", "P3-DxO_1.jpg", "PP4.jpg"])
    got = {(r["path"].rsplit("/", 1)[1], r["twin"].rsplit("/", 1)[1]) for r in files.twins(raws, outs).collect()}
    assert got == {("P1.ORF", "P1.dng"), ("P2.ORF", "x-P2.tif"), ("P3.ORF", "P3-DxO_1.jpg")}


def test_digest_times_labels(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.jpg").write_bytes(b"abc")
    row = files.with_digest(files.listing(spark, str(tmp_path / "f"), content=True)).first()
    assert row["digest"].startswith("ba7816bf") and row["cache_key"].startswith("a.jpg|3|")
    t = files.capture_times(spark.createDataFrame([("2021:03:01 10:00:00.5", None), ("bad", "2020:01:01 00:00:00"), (None, None)], "a string, b string"), "a", "b")
    assert [None if r["time"] is None else r["time"].year for r in t.collect()] == [2021, 2020, None]
    (tmp_path / "labels.txt").write_text("# note\nfox\n\n #kept\n")
    assert [r["label"] for r in files.label_list(spark, str(tmp_path / "labels.txt")).orderBy("idx").collect()] == ["fox", "#kept"]


def test_report_checks(spark, tmp_path):
    good = tmp_path / "r.csv"
    good.write_text('﻿file,selected,note\na.jpg,1,"x, y"\nb.jpg,0,\n')
    assert [tuple(r) for r in files.read_report(spark, str(good)).collect()] == [("a.jpg", "1", "x, y"), ("b.jpg", "0", "")]
    for bad in ("file,file,selected\na,b,1\n", "file,note\na,b\n", "file,selected\na,2\n"):
        p = tmp_path / "bad.csv"
        p.write_text(bad)
        with pytest.raises(ValueError):
            files.read_report(spark, str(p)).collect()


def test_manifest_integrity(spark, tmp_path):
    shoot = {"id": "s", "split": "heldout", "root": ".", "photos": [{"id": "a", "file": "a.jpg"}, {"id": "b", "file": "b.jpg"}], "favourites": ["a"], "rejected": ["b"], "acceptable": [["a", "b"]], "preferences": [{"winner": "a", "loser": "b"}]}
    p = tmp_path / "m.json"
    p.write_text(json.dumps({"version": 1, "shoots": [shoot]}))
    m = files.read_manifest(spark, str(p))
    assert m["photos"].count() == 2 and m["preferences"].first()["winner"] == "a"
    for change in ({"favourites": ["zz"]}, {"rejected": ["a"]}):
        p.write_text(json.dumps({"version": 1, "shoots": [{**shoot, **change}]}))
        with pytest.raises(ValueError):
            files.read_manifest(spark, str(p))


def test_features_are_incremental(spark, tmp_path):
    path, ddl = str(tmp_path / "feat"), "cache_key string, v array<float>, extra double"
    assert features.load(spark, path, ddl).count() == 0
    features.save(spark.createDataFrame([("a", [1.0], None), ("b", [float("nan")], 2.0)], ddl), path, "det")
    old = features.load(spark, path, ddl, "det")
    assert {(r["cache_key"], r["v"] is None) for r in old.collect()} == {("a", False), ("b", True)}
    assert features.load(spark, path, ddl, "other").count() == 0
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "cache_key string")
    assert {tuple(r) for r in features.todo(items, old, needed=["extra"]).collect()} == {("c", "new"), ("a", "extra")}
    merged = features.merge(old, spark.createDataFrame([("a", [2.0], 1.0)], ddl))
    features.save(merged, path, "det")
    assert {r["cache_key"]: r["extra"] for r in features.load(spark, path, ddl, "det").collect()} == {"a": 1.0, "b": 2.0}


def test_pixels():
    board = np.indices((64, 64)).sum(0) % 2 * 255.0
    flat = np.full((64, 64), 128.0)
    assert images.sharpness(board) > images.sharpness(flat) == 0 and images.sharpness(np.zeros((2, 2))) == 0
    assert images.exposure(np.array([[0.0, 255.0], [128.0, 128.0]]))[:2] == (0.25, 0.25)
    sig = images.signature(np.random.default_rng(0).uniform(0, 255, (100, 80)))
    assert sig.shape == (576,) and abs(sig.mean()) < 1e-9 and abs(np.linalg.norm(sig) - 1) < 1e-3
    rgb = np.random.default_rng(1).integers(0, 256, (40, 50, 3)).astype(np.uint8)
    assert (images.enhance(rgb, {"saturation": 0.3, "vignette": 0.4}, 0.0) == rgb).all()
    for name in images.EDITS:
        out = images.enhance(rgb, {name: 0.5})
        assert out.shape == rgb.shape and out.dtype == np.uint8
    grey = images.enhance(rgb, {"black_white": 1.0, "saturation": 1.0})
    assert np.ptp(grey.astype(int), axis=2).max() <= 1
    assert images.region_focus(rgb, (0, 0, 0.1, 0.1)) is None and images.region_focus(rgb, (0, 0, 1, 1)) > 0


def test_measures_over_the_image_source(spark, tmp_path):
    import struct
    import zlib

    def png(path, x):
        raw = b"".join(b"\0" + row.tobytes() for row in x)
        chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
        head = struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, 2, 0, 0, 0)
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))

    red = np.zeros((32, 32, 3), dtype=np.uint8)
    red[..., 0] = 200
    png(tmp_path / "red.png", red)
    (tmp_path / "bad.png").write_bytes(b"nothing")
    got = {r["path"].rsplit("/", 1)[1]: r for r in images.measure(spark.read.format("image").load(str(tmp_path))).collect()}
    assert got["red.png"]["warmth"] == 200 and got["red.png"]["readable"] and not got["bad.png"]["readable"]


def test_exif_of_a_turned_picture():
    import struct

    from gleanframe.functions import exif

    for order, mark in (("<", b"II"), (">", b"MM")):
        entry = lambda tag, kind, value: struct.pack(order + "HHI", tag, kind, 1) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))  # noqa: E731, B023
        main = [entry(0x0100, 4, 400), entry(0x0101, 3, 300), entry(0x0112, 3, 6), entry(0x8769, 4, 8 + 2 + 4 * 12 + 4)]
        child = [entry(0xA002, 4, 400), entry(0xA003, 4, 300), entry(0x8827, 3, 200)]
        block = mark + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", 4) + b"".join(main) + struct.pack(order + "I", 77)
        block += struct.pack(order + "H", 3) + b"".join(child) + struct.pack(order + "I", 0) + b"tail"
        out = exif.resized(b"Exif\0\0" + block, 300, 400)
        got = exif.tags(out[6:])
        assert (got[0x0100], got[0x0101], got[0x0112], got[0xA002], got[0xA003], got[0x8827]) == (300, 400, 1, 300, 400, 200)
        assert len(out) == len(block) + 6 and out.endswith(b"tail") and struct.unpack_from(order + "I", out, 6 + 8 + 2 + 48)[0] == 0
        for bad in (b"Exif\0\0" + block[:20], b"none", b"Exif\0\0" + block.replace(struct.pack(order + "H", 42), struct.pack(order + "H", 43), 1)):
            with pytest.raises(ValueError):
                exif.resized(bad, 300, 400)
        with pytest.raises(ValueError):
            exif.resized(b"Exif\0\0" + block, 300, 70_000)


def test_labels_of_any_number(spark, tmp_path):
    p = tmp_path / "labels.txt"
    p.write_text("# first\n" + "".join(f"label {i}\n\n" for i in range(12_000)))
    rows = files.label_list(spark, str(p)).orderBy("idx").collect()
    assert len(rows) == 12_000 and rows[11_999]["label"] == "label 11999" and rows[0]["idx"] == 0


def test_sidecars_are_written_once(spark, tmp_path):
    from gleanframe.operators import reporting

    df = spark.createDataFrame([("a/x.xmp", "one"), ("b/y.xmp", "two")], "name string, text string")
    assert all(r["written"] for r in reporting.write_sidecars(df, str(tmp_path), "name", "text").collect())
    again = df.withColumn("text", F.lit("three"))
    assert not any(r["written"] for r in reporting.write_sidecars(again, str(tmp_path), "name", "text").collect())
    assert (tmp_path / "a/x.xmp").read_text() == "one"
    assert all(r["written"] for r in reporting.write_sidecars(again, str(tmp_path), "name", "text", True).collect()) and (tmp_path / "b/y.xmp").read_text() == "three"
