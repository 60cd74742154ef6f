"""Positions in texts: bytes and the code units of editors, by lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What an editor counts columns in (fixed values); anything else counts as the last.
ENCODINGS = ("utf-8", "utf-32", "utf-16")


class Places:
    """Prefix sums over a text's bytes: where its lines begin, and code units before each byte.

    A text is taken as UTF-8 bytes; lines end at line feeds, and what ends them has no columns.
    """

    def __init__(self, text: bytes, encoding: str):
        data = np.frombuffer(text, np.uint8)
        first = (data & 0xC0) != 0x80
        units = first.astype(np.int64) if encoding in ("utf-16", "utf-32") or encoding not in ENCODINGS else np.ones(len(data), np.int64)
        if encoding not in ("utf-8", "utf-32"):
            units += data >= 0xF0  # a pair of surrogates
        self.size, self.before = len(data), np.concatenate(([0], np.cumsum(units)))
        self.whole = np.concatenate((first, [True]))  # bytes that begin a character, and the end
        self.starts = np.concatenate(([0], np.flatnonzero(data == 10) + 1))
        stops = np.concatenate((self.starts[1:], [len(data)]))
        trimmed = np.concatenate(([-1], np.where((data != 10) & (data != 13), np.arange(len(data)), -1)))
        last = np.maximum.accumulate(trimmed)[stops] + 1
        self.ends = np.maximum(last, self.starts)

    def offsets(self, line: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Byte offsets of lines and columns from 0 on; -1 where there is no such place."""
        good = (line >= 0) & (line < len(self.starts)) & (unit >= 0)
        own = np.where(good, line, 0)
        start, end = self.starts[own], self.ends[own]
        target = self.before[start] + unit
        # the character with so many units before it, or the end of the line
        places = np.flatnonzero(self.whole)
        at = places[np.minimum(np.searchsorted(self.before[places], target), len(places) - 1)]
        good &= (at <= end) & (self.before[at] == target)
        return np.where(good, at, -1)

    def positions(self, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lines and columns from 0 on of byte offsets; -1 inside a character or outside the text."""
        good = (offset >= 0) & (offset <= self.size)
        own = np.where(good, offset, 0)
        line = np.searchsorted(self.starts, own, "right") - 1
        within = np.minimum(own, self.ends[line])
        good &= self.whole[within]
        return np.where(good, line, -1), np.where(good, self.before[within] - self.before[self.starts[line]], -1)


def _each(batches: Iterator[pa.RecordBatch], names: list[str], work) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, encoding, points) with two columns of numbers in place of text and points: work tells them of each text once."""
    for batch in batches:
        ids, points = batch.column(0), batch.column(3)
        out: list[list] = [[], [], [], []]
        for i, (text, encoding) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            own = points[i].as_py() or []
            if not own:
                continue
            asked = np.array([[p["a"], p["b"]] for p in own], np.int64)
            found = work(Places((text or "").encode(), encoding or ""), asked)
            out[0] += [ids[i].as_py()] * len(own)
            out[1] += [p["point"] for p in own]
            out[2] += found[0].tolist()
            out[3] += found[1].tolist()
        arrays = [pa.array(out[0], ids.type), *(pa.array(c, pa.int64()) for c in out[1:])]
        yield pa.RecordBatch.from_arrays(arrays, names)


def _asked(texts: DataFrame, points: DataFrame, a: str, b: str) -> DataFrame:
    """Texts (id, text, encoding) once each with all of their points."""
    gathered = points.groupBy("id").agg(F.collect_list(F.struct(F.col("point").cast("long").alias("point"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))).alias("points"))
    return texts.select("id", "text", "encoding").join(gathered, "id").select("id", "text", "encoding", "points")


def to_editor(texts: DataFrame, points: DataFrame) -> DataFrame:
    """(id, point, line, unit): places of points (id, point, line, col) as an editor counts them, from 0 on.

    col counts bytes and both begin with 1; columns before or after a line are its ends, while a
    line that isn't there, and a column inside a character, are -1. texts: id, text, encoding. A text's points are a
    request's; each text is scanned once for all of them.
    """

    def work(places: Places, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        good = (asked[:, 0] >= 1) & (asked[:, 0] <= len(places.starts))
        line = np.where(good, asked[:, 0] - 1, 0)
        within = np.clip(asked[:, 1] - 1, 0, places.ends[line] - places.starts[line])
        lines, units = places.positions(np.where(good, places.starts[line] + within, -1))
        return lines, units

    kind = texts.schema["id"].dataType.simpleString()
    return _asked(texts, points, "line", "col").mapInArrow(lambda b: _each(b, ["id", "point", "line", "unit"], work), f"id {kind}, point long, line long, unit long")


def from_editor(texts: DataFrame, points: DataFrame) -> DataFrame:
    """(id, point, line, col): an editor's points (id, point, line, unit) by lines and bytes from 1 on.

    A unit inside a character, after its line's end, or on a line that isn't there, gives -1 twice.
    """

    def work(places: Places, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = places.offsets(asked[:, 0], asked[:, 1])
        line = np.searchsorted(places.starts, np.maximum(at, 0), "right") - 1
        return np.where(at >= 0, line + 1, -1), np.where(at >= 0, at - places.starts[line] + 1, -1)

    kind = texts.schema["id"].dataType.simpleString()
    return _asked(texts, points, "line", "unit").mapInArrow(lambda b: _each(b, ["id", "point", "line", "col"], work), f"id {kind}, point long, line long, col long")
