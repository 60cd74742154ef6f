"""Packing by minimum bin slack: subset sums of the lengths that remain, as bits of an integer, fill one window after another."""

from __future__ import annotations

import bisect
import functools
import itertools
import os
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .shared import table
from .textgrams import binary_view, give_back

PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Chunks of text that a worker keeps the ids of: the first, and so the frequent ones; others are encoded again.
CACHED_CHUNKS = 400_000
#: Text that is encoded at a time, and tokens that wait in a task before windows are filled.
TEXT_BYTES, WAITING = 4 << 20, 4 << 20
#: White space beyond ASCII, and what a special token begins with: such texts are encoded whole.
PLAIN = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|<\|"
#: Classes of bytes: 0 other ASCII, 1 letters, 2 digits, 3 white space, 4 beyond ASCII.
CLASS = np.zeros(256, np.uint8)
CLASS[[*range(65, 91), *range(97, 123)]] = 1
CLASS[48:58] = 2
CLASS[[9, 10, 11, 12, 13, 32]] = 3
CLASS[128:] = 4


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ChunkCoder:
    """Token ids of texts, chunk by chunk.

    The tokenizer's pattern matches a run of letters, of digits, or of other marks, with one space
    before it, or white space, or an apostrophe with some letters. So one match ends and another
    begins where white space follows anything else, and where two ASCII bytes of different class
    meet, unless the first is white space or an apostrophe. Merges don't cross matches, so the ids
    of a text are those of its chunks between such places. There are few distinct chunks.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}

    def _encode(self, chunks: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(chunks), 10_000):
            out += [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks[i : i + 10_000], add_special_tokens=False)]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and where each begins and the last ends."""
        data, at = binary_view(texts.cast(pa.string()))
        data, at = data[at[0] : at[-1]], at - at[0]
        kind = CLASS[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (kind[:-1] != 3) & ((kind[1:] == 3) | (kind[1:] != kind[:-1]) & (kind[1:] != 4) & (kind[:-1] != 4) & (data[:-1] != 39))
        cut[at] = True
        odd = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, PLAIN).fill_null(False)))
        for i in odd.tolist():
            cut[at[i] + 1 : at[i + 1]] = False
        edges = np.flatnonzero(cut)
        chunks = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)) if len(edges) > 1 else pa.array([], pa.string())
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [c for c in distinct if c not in self.known]
        fresh = dict(zip(new, self._encode(new)))
        ids = [self.known[c] if c in self.known else fresh[c] for c in distinct]
        if len(self.known) + len(fresh) <= CACHED_CHUNKS:
            self.known.update((c, x) for c, x in fresh.items() if len(c) <= 64)
        size = np.array([len(x) // 4 for x in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), "<u4")
        which = np.asarray(coded.indices)
        many = size[which]
        ends = np.concatenate(([0], np.cumsum(many)))
        out = flat[np.repeat((np.cumsum(size) - size)[which] - ends[:-1], many) + np.arange(ends[-1])]
        return out, ends[np.searchsorted(edges, at)]


@functools.lru_cache(1)
def worker_coder(path: str, job: str) -> ChunkCoder:
    """One for all of a job's tasks in a worker; each job begins anew."""
    return ChunkCoder(path)


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> tuple[int, list[tuple[int, int]]]:
    """The largest sum up to `room` of lengths (rising) taken `counts` times at most, and how often it takes each.

    Bit s of an integer is set if some of the lengths so far add up to s. Lengths, the largest
    first, come in until the room itself is reached or none is left; then the counts are read
    back from the bits before each length.
    """
    within, reached, before = (1 << room + 1) - 1, 1, []
    for i in range(bisect.bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[i]
        before.append((length, reached))
        left, step = min(counts[length], room // length), 1
        while left:
            step = min(step, left)
            reached |= reached << step * length & within
            left -= step
            step *= 2
        if reached >> room & 1:
            break
    best = at = reached.bit_length() - 1
    taken = []
    for length, bits in reversed(before):
        n = 0
        while not bits >> at & 1:
            at -= length
            n += 1
        if n:
            taken.append((length, n))
    return best, taken


class Windows:
    """Items of (length, document, first token) fill windows of `most` tokens.

    The longest item opens a window, and the multiset of remaining lengths that leaves the least
    slack closes it. Where some is left, an item that doesn't fit gives its first tokens. A last
    window ends in parts of the powers of two that its tokens add up to, which are never padded.
    """

    def __init__(self, most: int, number: int):
        self.most, self.tokens, self.number = most, 0, number
        self.waiting: dict[int, list] = defaultdict(list)
        self.counts, self.lengths = {}, []

    def add(self, length: int, doc, start: int) -> None:
        self.waiting[length].append((doc, start))
        self.tokens += length
        self.counts[length] = n = self.counts.get(length, 0) + 1
        if n == 1:
            bisect.insort(self.lengths, length)

    def _take(self, length: int) -> tuple:
        doc, start = self.waiting[length].pop()
        self.tokens -= length
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.counts[length], self.waiting[length], self.lengths[bisect.bisect_left(self.lengths, length)]
        return doc, start, length

    def _close(self, parts: list[tuple], out: list[tuple]) -> None:
        offset = 0
        for doc, start, length in parts:
            out.append((doc, start, length, self.number, offset))
            offset += length
        self.number += 1

    def fill(self, rest: int) -> list[tuple]:
        """Rows (document, start, length, sequence, offset) of full windows, until under `rest` tokens, or a window's worth, wait."""
        out: list[tuple] = []
        while self.tokens >= max(rest, self.most):
            parts = [self._take(self.lengths[-1])]
            room = self.most - parts[0][2]
            best, taken = fullest(self.counts, self.lengths, room)
            parts += [self._take(length) for length, n in taken for _ in range(n)]
            if best < room:
                doc, start, length = self._take(self.lengths[-1])
                parts.append((doc, start, room - best))
                self.add(length - (room - best), doc, start + room - best)
            self._close(parts, out)
        return out

    def finish(self) -> list[tuple]:
        """Rows of all that is left, in sequences of powers of two."""
        out = self.fill(0)
        left = [self._take(k) for k in self.lengths[::-1] for _ in range(self.counts[k])]
        total, at = sum(x[2] for x in left), 0
        for power in (1 << k for k in range(total.bit_length() - 1, -1, -1)):
            if not total & power:
                continue
            parts, need = [], power
            while need:
                doc, start, length = left[at]
                part = min(need, length)
                parts.append((doc, start, part))
                left[at], need = (doc, start + part, length - part), need - part
                at += part == length
            self._close(parts, out)
        return out


def pack_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, most: int = 2048, end_id: int = 1) -> DataFrame:
    """Each document's ids and the end id, in pieces that lie on end in sequences of at most `most` tokens.

    A document is cut at whole windows; what is left of it (or all of a shorter one) is an item. Each task
    packs the documents of its own partition, up to WAITING tokens at a time, so that nothing is
    shuffled; full windows have `most` tokens, and a task's last ones powers of two, so that none is padded.
    `sequence_id` is the partition's number and a count. A partition that is read again gives the
    same rows. Null text is empty (its only token is the end id); null and repeated ids keep
    their rows; an empty table gives none; other columns are not looked at. most is a power of two.
    """
    path, job, last = path or tokenizer_path(), uuid.uuid4().hex, np.asarray([end_id], "<u4")
    kind = docs.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder, windows, kept = worker_coder(path, job), Windows(most, TaskContext.get().partitionId() << 40), {}
        names, types = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], [pa.int64()] * 6

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns, ids = [], []
            for doc, start, length, sequence, offset in found:
                own = kept[doc]
                own[3] -= length
                columns.append((start, length, zlib.crc32(own[1][start - own[4] : start - own[4] + length].tobytes()), own[2], sequence, offset))
                ids.append(own[0])
                if not own[3]:
                    del kept[doc]
            arrays = [pa.array(c, t) for c, t in zip(zip(*columns), types)] if columns else [pa.array([], t) for t in types]
            return pa.RecordBatch.from_arrays([pa.array(ids, batch_type), *arrays], [id_col, *names])

        batch_type, count = None, itertools.count()
        for batch in batches:
            batch_type = batch.column(0).type
            ids, size = batch.column(0).to_pylist(), np.asarray(pc.binary_length(batch.column(1)).fill_null(0))
            group = (np.cumsum(size) // TEXT_BYTES).tolist()
            edges = [i for i in range(len(ids)) if not i or group[i] != group[i - 1]] + [len(ids)]
            for i, j in itertools.pairwise(edges):
                flat, at = coder.encode(batch.column(1)[i:j])
                found = []
                for d in range(i, j):
                    own = np.concatenate((flat[at[d - i] : at[d - i + 1]], last))
                    doc, whole = next(count), len(own) // most * most
                    # [id, the ids that are not placed, all tokens, tokens not placed, the first of these]
                    kept[doc] = [ids[d], own, len(own), len(own), 0]
                    for start in range(0, whole, most):
                        found.append((doc, start, most, windows.number, 0))
                        windows.number += 1
                    if whole < len(own):
                        windows.add(len(own) - whole, doc, whole)
                cut = {doc for doc, *_ in found}
                if found:
                    yield rows(found)
                for doc in cut & kept.keys():
                    kept[doc][1], kept[doc][4] = kept[doc][1][kept[doc][2] - kept[doc][3] :].copy(), kept[doc][2] - kept[doc][3]
                if windows.tokens >= WAITING:
                    yield rows(windows.fill(WAITING // 4))
            give_back()
        if kept:
            yield rows(windows.finish())

    return docs.select(id_col, text_col).mapInArrow(pack, f"{id_col} {kind}, {PIECE}")


def op13_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_windows(table(spark, sf_dir, "documents"))
