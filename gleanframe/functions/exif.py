"""Capture time, ISO and orientation from the TIFF tags of JPEG and TIFF-style raw files, without an image library."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Tag numbers and the sizes of the value types.
ORIENTATION, DATE, EXIF_IFD, ORIGINAL, ISO = 0x0112, 0x0132, 0x8769, 0x9003, 0x8827
_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _tiff(data: bytes) -> bytes | None:
    """The TIFF block: the file itself, or the Exif segment of a JPEG."""
    if data[:2] in (b"II", b"MM"):
        return data
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        if kind == 0xDA:
            return None
        at += 2 + size
    return None


def tags(data: bytes | None) -> dict[int, object]:
    """Tags of the first directory and its Exif directory; anything that cannot be read is left out."""
    out: dict[int, object] = {}
    block = _tiff(data or b"")
    if not block or len(block) < 8:
        return out
    e = "<" if block[:2] == b"II" else ">"
    todo, seen = [struct.unpack(e + "I", block[4:8])[0]], set()
    while todo:
        at = todo.pop()
        if at in seen or at + 2 > len(block):
            continue
        seen.add(at)
        for i in range(struct.unpack(e + "H", block[at : at + 2])[0]):
            entry = block[at + 2 + 12 * i : at + 14 + 12 * i]
            if len(entry) < 12:
                break
            tag, kind, count = struct.unpack(e + "HHI", entry[:8])
            size = _SIZE.get(kind, 0) * count
            where = 8 if size <= 4 else None
            raw = entry[where : where + size] if where else block[struct.unpack(e + "I", entry[8:])[0] :][:size]
            if not size or len(raw) < size:
                continue
            if kind == 2:
                out.setdefault(tag, raw.split(b"\0")[0].decode("ascii", "replace"))
            elif kind in (3, 4):
                out.setdefault(tag, struct.unpack(e + ("H" if kind == 3 else "I"), raw[: 2 if kind == 3 else 4])[0])
            if tag == EXIF_IFD and isinstance(out.get(tag), int):
                todo.append(out[tag])
    return out


def read_exif(files: DataFrame) -> DataFrame:
    """``path, taken, changed, iso, orientation`` of a listing with content: texts as written (``sources.files.capture_times`` reads them),
    NULL where a tag is missing or the file cannot be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [tags(bytes(c) if c is not None else None) for c in b.content]
            number = lambda k: pd.array([f.get(k) if isinstance(f.get(k), int) else None for f in found], dtype="Int64")
            text = lambda k: [f.get(k) if isinstance(f.get(k), str) else None for f in found]
            yield pd.DataFrame({"path": b.path, "taken": text(ORIGINAL), "changed": text(DATE), "iso": number(ISO), "orientation": number(ORIENTATION)})

    return files.select("path", "content").mapInPandas(run, "path string, taken string, changed string, iso long, orientation long")


# Tags of the size and the turn of the picture.
WIDTH, HEIGHT, PIXEL_X, PIXEL_Y = 0x0100, 0x0101, 0xA002, 0xA003


class _Directory:
    """The entries of one directory of a TIFF block and where it starts and ends."""

    def __init__(self, block: bytes, order: str, at: int) -> None:
        if at < 8 or at + 2 > len(block):
            raise ValueError("a directory lies outside its block")
        self.start, n = at, struct.unpack_from(order + "H", block, at)[0]
        self.next = at + 2 + 12 * n
        if self.next + 4 > len(block):
            raise ValueError("a directory is cut off")
        self.entries = {}
        for p in range(at + 2, self.next, 12):
            tag, kind, count = struct.unpack_from(order + "HHI", block, p)
            self.entries.setdefault(tag, []).append((p, kind, count))


def resized(exif: bytes, width: int, height: int) -> bytes:
    """An Exif segment made true for a turned picture of the given size: size and turn are written where their tags are, and the thumbnail,
    which shows the picture before, is unlinked. No byte moves, so all offsets stay valid; a layout in which that is not sure is an error."""
    if exif[:6] != b"Exif\0\0" or len(exif) < 14 or exif[6:8] not in (b"II", b"MM"):
        raise ValueError("no Exif segment")
    block, order = bytearray(exif[6:]), "<" if exif[6:8] == b"II" else ">"
    magic, first = struct.unpack_from(order + "HI", block, 2)
    if magic != 42:
        raise ValueError("no classic TIFF block")
    main = _Directory(block, order, first)
    changes = [(main, {ORIENTATION: 1, WIDTH: width, HEIGHT: height})]
    links = main.entries.get(EXIF_IFD, [])
    if len(links) > 1 or any(kind not in (4, 13) or count != 1 for _, kind, count in links):
        raise ValueError("no single link to the Exif directory")
    at = struct.unpack_from(order + "I", block, links[0][0] + 8)[0] if links else 0
    if at:
        child = _Directory(block, order, at)
        if child.start < main.next + 4 and main.start < child.next + 4:
            raise ValueError("directories overlap")
        changes.append((child, {PIXEL_X: width, PIXEL_Y: height}))
    for where, values in changes:
        for tag, value in values.items():
            for p, kind, count in where.entries.get(tag, []):
                form = {3: "H", 4: "I"}.get(kind)
                if form is None or count != 1 or not 0 <= value < 256 ** struct.calcsize(order + form):
                    raise ValueError(f"tag {tag:#06x} cannot hold {value}")
                struct.pack_into(order + form, block, p + 8, value)
    struct.pack_into(order + "I", block, main.next, 0)
    return exif[:6] + bytes(block)
