"""Substring dedup: runs of consecutive sentences and pieces of them, hashed, joined over all documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import key_filter, maybe_in, release, rows_of, stage, table
from .textgrams import BASE, SEGMENT, SPACE, _tables, binary_view, give_back, mixed, packed, unpacked, word_hashes

_U = np.uint64
STOPS = np.zeros(256, bool)
STOPS[[ord(c) for c in ".!?"]] = True
CLOSERS = np.zeros(256, bool)
CLOSERS[[ord(c) for c in "\"')]"]] = True
#: Every sentence is cut into pieces after words whose hash says so, one in CUT, wherever it stands.
CUT = 4
#: Runs in a block of documents, and bits of a hash that only choose its shard.
BLOCK, KEY_BITS = 1 << 19, _U(20)


def sentences(strings: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each document: its row, byte offsets where pieces begin, words' prefix hashes there, word counts, and the pieces with which sentences begin.

    A sentence ends with a word that ends in . ! or ? (and closing marks), or at a line break.
    Within it, pieces end after words picked by their hash alone, so that equal passages are cut
    alike. Prefixes, counts and sentences have the end of the document too.
    """
    data, at = binary_view(strings)
    for i, j, words, doc in word_hashes(strings):
        part = data[at[i] : at[j]]
        ink = ~SPACE[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[at[i : j + 1] - at[i]] = True
        starts = np.flatnonzero(ink & (edge[:-1] | ~np.concatenate(([False], ink[:-1]))))
        ends = np.flatnonzero(ink & (edge[1:] | ~np.concatenate((ink[1:], [False])))) + 1
        if len(words) == 0:
            for d in range(i, j):
                yield d, np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(1, np.int64)
            continue
        last = part[ends - 1]
        stop = STOPS[last] | (CLOSERS[last] & STOPS[part[np.maximum(ends - 2, 0)]] & (ends - starts > 1))
        lines = np.concatenate(([0], np.cumsum(part == 10)))
        following = np.concatenate((starts[1:], [len(part)]))
        stop |= lines[following] > lines[ends]
        stop[:-1] |= doc[1:] != doc[:-1]
        stop[-1] = True
        opens = np.concatenate(([True], stop[:-1]))
        stop |= mixed(words) % _U(CUT) == 0
        begin = np.concatenate(([0], np.flatnonzero(stop[:-1]) + 1))
        size = np.diff(np.concatenate((begin, [len(words)])))
        power, inverse = _tables(len(words))
        rolled = np.concatenate((np.zeros(1, _U), np.cumsum(words * power[: len(words)])))
        bounds = np.searchsorted(doc[begin], np.arange(i, j + 1))
        for d in range(i, j):
            a, b = bounds[d - i], bounds[d - i + 1]
            first = begin[a:b]
            # a prefix hash and the inverse power make runs of any sentences of this document comparable
            whole = np.concatenate((first, [begin[b] if b < len(begin) else len(words)])) if b > a else np.zeros(0, np.int64)
            base = whole[0] if b > a else 0
            prefix = (rolled[whole] - rolled[base]) * inverse[base] if b > a else np.zeros(0, _U)
            yield d, starts[first] + at[i] - at[d], prefix, np.concatenate(([0], np.cumsum(size[a:b]))) if b > a else np.zeros(0, np.int64), np.concatenate((np.flatnonzero(opens[first]), [b - a]))


def runs_of(counts: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First pieces of the runs of a document, and the pieces after their last.

    From each piece on goes the shortest run of `least_words` words, and up to each the shortest,
    so that a repeated passage is covered from its first piece to its last.
    """
    n, far = len(counts) - 1, len(counts)
    ends = np.searchsorted(counts, counts[:-1] + least_words)  # far if there are not so many words
    begins = np.searchsorted(counts, counts[1:] - least_words, "right") - 1  # -1 if there are not so many words
    on, up = np.flatnonzero(ends <= n), np.flatnonzero(begins >= 0)
    both = np.unique(np.concatenate((on * far + ends[on], begins[up] * far + up + 1)))
    return both // far, both % far


def run_hashes(prefix: np.ndarray, counts: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words of runs."""
    words = counts[end] - counts[begin]
    if len(counts) and counts[-1] < SEGMENT:
        inverse = _tables(int(counts[-1]) + 1)[1][counts[begin]]
    else:
        inverse = np.array([pow(pow(BASE, -1, 2**64), int(c), 2**64) for c in counts[begin]], _U)
    return mixed((prefix[end] - prefix[begin]) * inverse + words.astype(_U) * _U(0xC2B2AE3D27D4EB4F))


ROWS = "kind int, block long, shard int, keys array<long>, data binary"
RUNS, ASKS = range(2)


def repeated_runs(docs: DataFrame, least_words: int) -> DataFrame:
    """(row_key, pos, end): for each document with any, the runs that are not their first occurrence.

    docs: doc_id, row_key, text. First is the smallest doc_id (null last), then the order of the
    rows and of places. A block of documents asks, once for each of its runs, by a packed list to
    each shard, whether another block has it earlier, and gets a bit for an answer.
    """
    shards = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held, ids, keys, waiting = [], [], [], 0

        def sent() -> pa.RecordBatch:
            h, at, pos, end = (np.concatenate(x) for x in zip(*held))
            shard = ((h & _U(0xFFFFF)) % _U(shards)).astype(np.uint32)
            h, first = h >> KEY_BITS, np.array([2**63 - 1 if i is None else i for i in ids], np.int64)
            order = np.lexsort((pos, at, first[at], h, shard))
            h, at, shard, pos, end = h[order], at[order], shard[order], pos[order], end[order]
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (shard[1:] != shard[:-1])))
            rows = [(RUNS, block, None, keys, packed(np.cumsum(new) - 1, at, pos, end - pos))]
            h, shard, own = h[new], shard[new], first[at[new]]
            edges = np.searchsorted(shard, np.arange(shards + 1))
            rows += [(ASKS, block, s, None, packed(h[i:j], own[i:j])) for s, (i, j) in enumerate(zip(edges, edges[1:])) if i < j]
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["kind", "block", "shard", "keys", "data"])

        for batch in batches:
            every, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for d, _, prefix, counts, _ in sentences(batch.column(2)):
                if len(counts) and counts[-1] >= least_words:
                    pos, end = runs_of(counts, least_words)
                    held.append((run_hashes(prefix, counts, pos, end), np.full(len(pos), len(ids)), pos, end))
                    ids.append(every[d])
                    keys.append(marks[d])
                    waiting += len(pos)
                    if waiting >= BLOCK:
                        yield sent()
                        held, ids, keys, waiting, block = [], [], [], 0, block + 1
        if held:
            yield sent()

    def answer(key: tuple, rows: pa.Table) -> pa.Table:
        give_back()
        blocks, parts = rows.column("block").to_numpy(), [unpacked(x.as_py()) for x in rows.column("data")]
        size = np.array([x.shape[1] for x in parts])
        (h, own), of = np.concatenate(parts, 1), np.repeat(blocks, size)
        order = np.lexsort((of, own, h))
        later = np.zeros(len(h), bool)
        later[order[1:]] = h[order[1:]] == h[order[:-1]]
        bits = [np.packbits(x).tobytes() for x in np.split(later, np.cumsum(size)[:-1])]
        return pa.table({"block": blocks, "shard": pa.array(np.full(len(size), key[0].as_py()), pa.int32()), "size": size, "bits": bits})

    def told(runs: pa.Table, answers: pa.Table) -> pa.Table:
        give_back()
        group, at, pos, size = unpacked(runs.column("data")[0].as_py()).astype(np.int64)
        order = np.argsort(answers.column("shard").to_numpy())
        n, bits = answers.column("size").to_pylist(), answers.column("bits").to_pylist()
        later = np.concatenate([np.unpackbits(np.frombuffer(bits[i], np.uint8), count=n[i]) for i in order]).astype(bool)
        hit = later[group] | np.concatenate(([False], group[1:] == group[:-1]))
        at, pos, size = at[hit], pos[hit], size[hit]
        order = np.argsort(at, kind="stable")
        at, pos, end = at[order], pos[order].astype(np.int32), (pos + size)[order].astype(np.int32)
        who, begin = np.unique(at, return_index=True)
        edges = np.concatenate((begin, [len(at)])).astype(np.int32)
        keys = np.asarray(runs.column("keys")[0].as_py(), np.int64)[who]
        return pa.table({"row_key": keys, "pos": pa.ListArray.from_arrays(edges, pos), "end": pa.ListArray.from_arrays(edges, end)})

    rows = stage(docs.select("doc_id", "row_key", "text").mapInArrow(ask, ROWS), "runs", "kind")
    asked = rows.where(F.col("kind") == ASKS).select("block", "shard", "data")
    bits = asked.groupBy("shard").applyInArrow(answer, "block long, shard int, size long, bits binary")
    runs = rows.where(F.col("kind") == RUNS).select("block", "keys", "data")
    found = runs.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(told, "row_key long, pos array<int>, end array<int>")
    found = stage(found, "repeats")
    release(rows)
    return found


def dedup_spans(docs: DataFrame, *, id_col="doc_id", text_col="text", least_words=24) -> DataFrame:
    """Remove the pieces of sentences that a repeated run covers, but for its first occurrence.

    A run goes over sentences, and pieces of them, until it has `least_words` words. Sentences end
    at marks and line breaks; pieces, in sentences of any length, after words that a hash picks,
    so that where a passage is cut depends on its own words alone. Runs are compared by their
    words, A-Z lower-cased, whatever the white space between. What is left of a text keeps its bytes.

    Returns doc_id, n_sentences, n_removed (sentences that lose words), text. Null text stays null
    with no sentences; texts of fewer words than a run keep all; null ids come last in the order
    of occurrence; rows that repeat are documents of their own, of which the first keeps its
    words; an empty table gives no rows; other columns don't matter.
    """
    spark = docs.sparkSession
    docs = rows_of(docs, doc_id=F.col(id_col).cast("long"), text=F.col(text_col).cast("string"))
    found = repeated_runs(docs, least_words)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, pos, end = batch.column(1), batch.column(2), batch.column(3)
            total, removed, out = [], [], []
            for d, begin, _, _, heads in sentences(texts):
                n, text = len(begin), texts[d].as_py()
                hit = np.zeros(n + 1, np.int64)
                if pos[d].is_valid:
                    np.add.at(hit, pos[d].values.to_numpy(), 1)
                    np.add.at(hit, end[d].values.to_numpy(), -1)
                gone = np.cumsum(hit[:-1]) > 0 if n else np.zeros(0, bool)
                if gone.any():
                    raw = text.encode()
                    stops = [*begin[1:].tolist(), len(raw)]
                    text = (raw[: begin[0]] + b"".join(raw[a:b] for a, b, g in zip(begin.tolist(), stops, gone) if not g)).decode()
                total.append(len(heads) - 1)
                removed.append(int(np.logical_or.reduceat(gone, heads[:-1]).sum()) if n else 0)
                out.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())],
                ["doc_id", "n_sentences", "n_removed", "text"],
            )

    # only texts that lose words are shuffled
    touched = maybe_in("row_key", spark, key_filter(found.select("row_key")))
    lists = "array<int>"
    whole = docs.where(~touched).select("doc_id", "text", F.lit(None).cast(lists).alias("pos"), F.lit(None).cast(lists).alias("end"))
    marked = docs.where(touched).join(found.hint("merge"), "row_key", "left").select("doc_id", "text", "pos", "end")
    return whole.unionByName(marked).mapInArrow(cut, "doc_id long, n_sentences long, n_removed long, text string")


def op2_dedup_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans(table(spark, sf_dir, "documents"))
