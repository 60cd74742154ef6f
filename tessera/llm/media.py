"""Media columns: signature sniffing with Aho-Corasick, structural validation, carving."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import stage, table

#: Magic bytes by media type (fixed values).
SIGNATURES = {
    b"RIFF": "audio/wav",
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"\xff\xd8\xff": "image/jpeg",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"%PDF-": "application/pdf",
    b"PK\x03\x04": "application/zip",
    b"BM": "image/bmp",
}
RATE = 8000


class Found(NamedTuple):
    kind: str
    start: int
    end: int


class Bytes:
    """Bytes, and what validators have found out about them, so that many candidates cost no more than one pass."""

    def __init__(self, data: bytes):
        self.data, self.found, self.ends = data, {}, {}

    def find(self, what: bytes, at: int) -> int:
        """The first place of `what` from `at` on, or -1; candidates come in rising order."""
        since, hit = self.found.get(what, (len(self.data) + 1, -1))
        if not (since <= at and (hit < 0 or hit >= at)):
            hit = self.data.find(what, at)
            self.found[what] = at, hit
        return hit

    def end(self, kind: str, p: int, step: Callable[[int], tuple[int, bool]]) -> int:
        """Where a chain of parts from p on ends: step gives the next place, or the end and True. Chains that meet go on alike."""
        known, passed = self.ends.setdefault(kind, {}), []
        while p not in known:
            passed.append(p)
            p, over = step(p)
            if over:
                break
        else:
            p = known[p]
        known.update(dict.fromkeys(passed, p))
        return p


def _wav(media: Bytes, at: int) -> int:
    """End of a PCM wave file at `at`, or -1: sizes must agree with the chunks."""
    data = media.data
    if data[at + 8 : at + 12] != b"WAVE":
        return -1
    end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    p, seen = at + 12, set()
    if end > len(data):
        return -1
    while p + 8 <= end:
        name, size = data[p : p + 4], int.from_bytes(data[p + 4 : p + 8], "little")
        p += 8 + size + size % 2
        seen.add(name)
    return end if p == end and {b"fmt ", b"data"} <= seen else -1


def _png(media: Bytes, at: int) -> int:
    """End of a PNG file: chunks follow one another, each with its CRC, from an IHDR of 13 bytes to IEND."""
    data = media.data

    def step(p: int) -> tuple[int, bool]:
        size, name = int.from_bytes(data[p : p + 4], "big"), data[p + 4 : p + 8]
        stop = p + 12 + size
        if p + 12 > len(data) or stop > len(data) or zlib.crc32(memoryview(data)[p + 4 : stop - 4]) != int.from_bytes(data[stop - 4 : stop], "big"):
            return -1, True
        return stop, name == b"IEND"

    return media.end("png", at + 8, step) if data[at + 8 : at + 16] == b"\0\0\0\rIHDR" else -1


def _jpeg(media: Bytes, at: int) -> int:
    """End of a JPEG file: marker segments with lengths up to a scan, which ends at FFD9."""
    data = media.data

    def step(p: int) -> tuple[int, bool]:
        if p + 4 > len(data) or data[p] != 0xFF:
            return -1, True
        mark, size = data[p + 1], int.from_bytes(data[p + 2 : p + 4], "big")
        if not 0xC0 <= mark <= 0xFE or size < 2:
            return -1, True
        if mark == 0xDA:
            end = media.find(b"\xff\xd9", p + 2 + size)
            return (end + 2 if end >= 0 else -1), True
        return p + 2 + size, False

    return media.end("jpeg", at + 2, step)


def _gif(media: Bytes, at: int) -> int:
    """End of a GIF file: colour tables by their flags, then blocks of sub-blocks to the trailer."""
    data = media.data
    if at + 13 > len(data):
        return -1
    after = lambda p: (p + 1 + data[p], False) if p < len(data) and data[p] else (p + 1, True)

    def step(p: int) -> tuple[int, bool]:
        if p >= len(data):
            return -1, True
        kind = data[p]
        if kind == 0x3B:
            return p + 1, True
        if kind == 0x21:
            p += 2
        elif kind == 0x2C and p + 10 < len(data):
            p += 11 + (3 << ((data[p + 9] & 7) + 1) if data[p + 9] & 128 else 0)
        else:
            return -1, True
        return media.end("sub-blocks", p, after), False

    return media.end("gif", at + 13 + (3 << ((data[at + 10] & 7) + 1) if data[at + 10] & 128 else 0), step)


def _pdf(media: Bytes, at: int) -> int:
    if not media.data[at + 5 : at + 6].isdigit():
        return -1
    end = media.find(b"%%EOF", at)
    return end + 5 if end >= 0 and 0 <= media.find(b"startxref", at) <= end - 9 else -1


def _zip(media: Bytes, at: int) -> int:
    """End of a ZIP file: the directory's recorded place and size must lead to its end record."""
    data, end = media.data, media.find(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(data):
        return -1
    size, place = (int.from_bytes(data[end + k : end + k + 4], "little") for k in (12, 16))
    return end + 22 + int.from_bytes(data[end + 20 : end + 22], "little") if at + place + size == end else -1


def _bmp(media: Bytes, at: int) -> int:
    data = media.data
    size, pixels, head = (int.from_bytes(data[at + k : at + k + 4], "little") for k in (2, 10, 14))
    return at + size if at + size <= len(data) and head in (12, 40, 108, 124) and 14 + head <= pixels <= size and not any(data[at + 6 : at + 10]) else -1


VALIDATORS = {
    "audio/wav": _wav, "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif,
    "application/pdf": _pdf, "application/zip": _zip, "image/bmp": _bmp,
}


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic, kind in SIGNATURES.items():
        a.add_word(magic.decode("latin-1"), (kind, len(magic)))
    a.make_automaton()
    return a


def sniff(data: bytes, search) -> list[Found]:
    """Media in `data`, outermost and leftmost, whose structure and lengths hold.

    One automaton finds every magic string in a pass; a candidate inside confirmed media is
    part of it, and one that its format's validator rejects is chance.
    """
    found, beyond, media = [], 0, Bytes(data)
    for last, (kind, size) in search.iter(data.decode("latin-1")):
        at = last + 1 - size
        if at >= beyond and (end := VALIDATORS[kind](media, at)) > 0:
            found.append(Found(kind, at, end))
            beyond = end
    return found


def sniff_media(media: DataFrame, *, media_col="media", declared_col="declared") -> DataFrame:
    """Add media_type (of what begins the bytes, else the declared one) and carved.

    carved lists further media inside as struct(kind, start, end). Null and empty bytes keep the
    declared type and carve nothing.
    """
    more = StructType.fromDDL("media_type string, carved array<struct<kind:string,start:long,end:long>>")
    schema = StructType([*media.schema.fields, *more.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = automaton()
        for batch in batches:
            kinds, carved = [], []
            for data, declared in zip(batch.column(batch.schema.get_field_index(media_col)), batch.column(batch.schema.get_field_index(declared_col))):
                found = sniff(data.as_py() or b"", search)
                head = [f for f in found if f.start == 0]
                kinds.append(head[0].kind if head else declared.as_py())
                carved.append([f._asdict() for f in found if f.start])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds, pa.string()), pa.array(carved, kind)], [*batch.schema.names, "media_type", "carved"])

    return media.mapInArrow(run, schema)


def _le32(n: Column) -> Column:
    h = F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)]))


def as_wave(payload: Column) -> Column:
    """The payload as 8-bit mono samples in a RIFF wave file (its length is even)."""
    n = F.octet_length(payload).cast("long")
    text = lambda s: F.encode(F.lit(s), "UTF-8")
    fmt = b"".join(v.to_bytes(size, "little") for v, size in ((16, 4), (1, 2), (1, 2), (RATE, 4), (RATE, 4), (1, 2), (8, 2)))
    return F.concat(text("RIFF"), _le32(n + 36), text("WAVEfmt "), F.unhex(F.lit(fmt.hex())), text("data"), _le32(n), payload)


def store_payloads(docs: DataFrame, *, id_col="doc_id", text_col="text", unit=576) -> DataFrame:
    """A media column: each text's UTF-8 bytes, filled with 255 to a positive multiple of `unit`, as a wave file.

    Null text is empty; null ids, repeated rows and other columns change nothing; the declared
    type is 'application/octet-stream', for the sniffer to correct.
    """
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    n = F.octet_length(data)
    padded = F.rpad(data, (F.greatest(F.lit(1), F.ceil(n / unit)) * unit).cast("int"), F.unhex(F.lit("FF")))
    return docs.select(
        F.col(id_col).alias("doc_id"), n.cast("long").alias("n_bytes"),
        F.lit("application/octet-stream").alias("declared"), as_wave(padded).alias("media"),
    )


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(stored: DataFrame) -> DataFrame:
    """Sniff stored media, read their samples back, and describe them.

    feature: corrected type, number of samples, their mean and standard deviation to four
    places, and number of carved media. Bytes that are not a sound wave file raise an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = automaton()
        for batch in batches:
            rows = []
            for doc_id, n, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                media = cell.as_py()
                found = sniff(media, search)
                if not found or found[0] != Found("audio/wav", 0, len(media)):
                    raise ValueError(f"document {doc_id}: the stored media is not one whole wave file")
                payload = media[44:]
                inner = sniff(payload, search)
                x = np.frombuffer(payload, np.uint8)
                feature = f"{found[0].kind};samples={len(x)};mean={x.mean():.4f};sd={x.std():.4f};carved={len(inner)}"
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            cols = list(zip(*rows)) or [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [f.split()[0] for f in FEATURES.split(", ")])

    return stored.select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "media").mapInArrow(run, FEATURES)


def op10_sniff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(stage(store_payloads(table(spark, sf_dir, "documents")), "media"))
