"""Quality classifier: an interpolated modified Kneser-Ney trigram model and perplexity bars by language.

Words are 40-bit hashes, so the vocabulary has no limit; every n-gram of the trusted text is in the
model. Counts lie in shards, and so do the scores' lookups: blocks of documents ask the shards for
their distinct n-grams in sorted, packed lists, and the answers come back in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import bucketed, keyed, release, rows_of, settle, stage, table
from .textgrams import give_back, mixed, packed, pair, unpacked, word_hashes

_U = np.uint64
#: Bits of the filter that spares requests for n-grams that the model doesn't hold; a fuller one only spares fewer.
FILTER_BITS = 1 << 28
#: Labelled ids that are broadcast (9 bytes each); beyond, the rows are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Trigrams that a task gathers before it merges them and passes their counts on, and words in a block of documents.
GATHER, BLOCK = 1 << 19, 1 << 19
#: Parts of the documents that are asked for, answered and scored one after another, so that only one part's lists are kept at a time.
ROUNDS = 4
#: Bytes of files that a shard answers for, at the fewest as many shards as shuffle partitions; and the most shards.
SHARD_BYTES, MOST_SHARDS = 16 << 20, 1 << 16
#: Bits of a word's hash that are left out; low bits of an n-gram's that choose its shard, while the others tell the keys of a shard apart.
WORD_BITS, SHARD_BITS = _U(24), _U(28)
#: Kinds of rows of the counts: tables of the model, parts of counts on their way to a shard, counts of counts.
TRIGRAMS, CONTEXTS, BIGRAMS, WORDS, PARTS, LEVELS = range(6)
ROWS = "shard int, kind int, vocabulary binary, data binary"


class Model(NamedTuple):
    shards: int
    discounts: tuple[tuple[float, float, float], ...]  # of single words, bigrams and trigrams
    ends: float  # distinct bigrams
    spare: float  # p of a word that was never seen
    filter: np.ndarray
    tables: DataFrame | None  # shard, kind, data


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys & ((_U(1) << SHARD_BITS) - _U(1))) % _U(shards)).astype(np.int32)


def _triple(context: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of trigrams; the bits that choose the shard are those of the context."""
    low = (_U(1) << SHARD_BITS) - _U(1)
    return (pair(context, words) & ~low) | (context & low)


def _cut(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by shard, and where each shard begins in it."""
    small = shard.astype(np.uint16) if shards < 1 << 16 else shard
    return np.argsort(small, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(shard, minlength=shards))))


def _before(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's predecessor but one and predecessor in its document; 0 before its start."""
    b, a = np.zeros_like(words), np.zeros_like(words)
    b[1:] = np.where(doc[1:] == doc[:-1], words[:-1], _U(0))
    a[2:] = np.where(doc[2:] == doc[:-2], words[:-2], _U(0))
    return a, b


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Distinct keys in order; a plain sort is many times as fast as numpy's unique here."""
    own = np.sort(keys)
    return own[np.concatenate((np.ones(min(1, len(own)), bool), own[1:] != own[:-1]))]


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys, and where each distinct one begins in it."""
    order = np.argsort(keys)
    own = keys[order]
    return order, np.flatnonzero(np.concatenate((np.ones(min(1, len(own)), bool), own[1:] != own[:-1])))


def _sums(n: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of whole numbers over the stretches that begin there."""
    return np.add.reduceat(n, begins, dtype=np.int64) if len(begins) else np.zeros(0, np.int64)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sums of n, and a place of each."""
    order, begins = _groups(keys)
    at = order[begins]
    return keys[at], _sums(n[order], begins), at


def _vocabulary(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words, the frequent ones first by powers of two, and the place of each word among them."""
    sort, begins = _groups(words)
    n = np.diff(np.concatenate((begins, [len(words)])))
    order = np.argsort(-np.frexp(n)[1].astype(np.int8), kind="stable")
    place = np.empty(len(n), np.int64)
    place[order] = np.arange(len(n))
    at = np.empty(len(words), np.int64)
    at[sort] = np.repeat(place, n)
    return words[sort[begins]][order], at


def _coded(*cols: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """Columns of word hashes as places in their own vocabulary, with counts."""
    words, at = _vocabulary(np.concatenate(cols))
    cols, bits = at.reshape(len(cols), -1), len(words).bit_length()
    # as one number where they fit, which sorts faster than one column after another
    order = np.argsort(sum(c << bits * k for k, c in enumerate(cols[::-1]))) if bits * len(cols) < 64 else np.lexsort(cols[::-1])
    return packed(words), packed(*cols[:, order], n[order])


def _decoded(rows: pa.Table) -> list[np.ndarray]:
    parts = []
    for words, data in zip(rows.column("vocabulary"), rows.column("data")):
        words, cols = unpacked(words.as_py())[0], unpacked(data.as_py())
        parts.append([*(words[c.astype(np.int64)] for c in cols[:-1]), cols[-1].astype(np.int64)])
    return [np.concatenate(c) for c in zip(*parts)]


def _levels(n: np.ndarray) -> bytes:
    """How many have the counts 1 to 4, how many there are, and their sum."""
    return packed(np.arange(1, 7), np.concatenate(((n[:, None] == np.arange(1, 5)).sum(0), [len(n), n.sum()])))


def _parts(n: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    """Of each stretch: the sum of n, and how many have n of 1, 2 and more."""
    return [_sums(x, begins) for x in (n, n == 1, n == 2, n > 2)]


def _table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    cols = list(zip(*rows)) or [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], ["shard", "kind", "vocabulary", "data"])


def _count_trigrams(texts: DataFrame, shards: int) -> DataFrame:
    """Trigrams and contexts by the context's shard, with bigrams' distinct left neighbours on their way to their own."""

    def sent(a, b, c, n) -> list[tuple]:
        order, at = _cut(_shard(pair(a, b), shards), shards)
        return [(s, PARTS, *_coded(a[p], b[p], c[p], n=n[p])) for s in np.flatnonzero(np.diff(at)).tolist() if len(p := order[at[s] : at[s + 1]])]

    def merged(held: list) -> list:
        a, b, c, n = (np.concatenate(x) for x in zip(*held))
        _, n, at = _summed(_triple(pair(a, b), c), n)
        return [a[at], b[at], c[at], n]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in batches:
            for _, _, c, doc in word_hashes(batch.column(0)):
                c = c >> WORD_BITS
                a, b = _before(c, doc)
                held.append([a, b, c, np.ones(len(c), np.int64)])
                waiting += len(c)
                if waiting > GATHER:
                    held = [merged(held)]
                    waiting = len(held[0][0])
                    if waiting > GATHER // 2:
                        yield from _table(sent(*held[0])).to_batches()
                        held, waiting = [], 0
        if waiting:
            yield from _table(sent(*merged(held))).to_batches()

    def finish(key: tuple, rows: pa.Table) -> pa.Table:
        give_back()
        a, b, c, n = _decoded(rows)
        context = pair(a, b)
        k, n, at = _summed(_triple(context, c), n)
        context, b, c = context[at], b[at], c[at]
        order, begins = _groups(context)
        out = [(key[0].as_py(), TRIGRAMS, None, packed(k >> SHARD_BITS, n)), (key[0].as_py(), CONTEXTS, None, packed(context[order[begins]] >> SHARD_BITS, *_parts(n[order], begins))), (0, LEVELS, None, _levels(n))]
        tail, left, at = _summed(pair(b, c), np.ones(len(b), np.int64))
        b, c = b[at], c[at]
        order, edges = _cut(_shard(tail, shards), shards)
        return _table(out + [(s, PARTS, *_coded(b[p], c[p], n=left[p])) for s in np.flatnonzero(np.diff(edges)).tolist() if len(p := order[edges[s] : edges[s + 1]])])

    return texts.mapInArrow(gather, ROWS).groupBy("shard").applyInArrow(finish, ROWS)


def _count_bigrams(counts: DataFrame, shards: int) -> DataFrame:
    """Bigrams by distinct left neighbours, with what words begin and end on its way to the words' shards."""

    def finish(key: tuple, rows: pa.Table) -> pa.Table:
        give_back()
        b, c, n = _decoded(rows)
        k, n, at = _summed(pair(b, c), n)
        words = mixed(np.concatenate((b[at], c[at])))
        order, begins = _groups(words)
        words, starts = words[order[begins]], order < len(k)
        own = np.where(starts, n[order % max(1, len(k))], 0)
        cols = [_sums(~starts, begins), *_parts(own, begins)]
        order, edges = _cut(_shard(words, shards), shards)
        sent = [(s, PARTS, None, packed(words[p], *(x[p] for x in cols))) for s in np.flatnonzero(np.diff(edges)).tolist() if len(p := order[edges[s] : edges[s + 1]])]
        return _table([(key[0].as_py(), BIGRAMS, None, packed(k >> SHARD_BITS, n)), (0, LEVELS, None, _levels(n)), *sent])

    return counts.where(F.col("kind") == PARTS).groupBy("shard").applyInArrow(finish, ROWS)


def _count_words(counts: DataFrame) -> DataFrame:
    def finish(key: tuple, rows: pa.Table) -> pa.Table:
        give_back()
        parts = np.concatenate([unpacked(x.as_py()) for x in rows.column("data")], 1)
        order, begins = _groups(parts[0])
        words, cols = parts[0][order[begins]], [_sums(x[order].astype(np.int64), begins) for x in parts[1:]]
        ends = cols[0][cols[0] > 0]
        return _table([(key[0].as_py(), WORDS, None, packed(words >> SHARD_BITS, *cols)), (0, LEVELS, None, _levels(ends))])

    return counts.where(F.col("kind") == PARTS).groupBy("shard").applyInArrow(finish, ROWS)


def _discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """D1, D2 and D3+ from how many n-grams have the counts 1 to 4."""
    if not (n1 and n2 and n3):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


def _slot(keys: np.ndarray, shard: np.ndarray, shards: int) -> np.ndarray:
    """Bits of a filter in which every shard has a stretch of its own."""
    each = FILTER_BITS // shards // 8 * 8
    return shard.astype(np.int64) * each + (mixed(keys >> SHARD_BITS) % _U(each)).astype(np.int64)


def _filter(tables: DataFrame, shards: int) -> np.ndarray:
    """FILTER_BITS bits at any number of keys; each row of the tables makes its shard's stretch."""
    each = FILTER_BITS // shards // 8 * 8

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                bit = np.zeros(each, bool)
                bit[(mixed(unpacked(data.as_py())[0]) % _U(each)).astype(np.int64)] = True
                word = np.packbits(bit)
                at = np.flatnonzero(word)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([packed(at, word[at])], pa.binary())], ["shard", "data"])

    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in tables.select("shard", "data").mapInArrow(marked, "shard int, data binary").toLocalIterator():
        at, word = unpacked(bytes(row.data))
        out[row.shard * each // 8 + at.astype(np.int64)] |= word.astype(np.uint8)
    return out


def shards_for(docs: DataFrame) -> int:
    """Shards for the files that docs lie in."""
    files = docs.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).distinct()
    size = files.agg(F.sum("size")).first()[0] or 0
    return min(MOST_SHARDS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES)))


def train(texts: DataFrame, shards: int | None = None) -> Model:
    """Fit the model on every text.

    Discounts are those of modified Kneser-Ney at all three orders; what they leave of a context
    goes to the order below, and of single words evenly to all words and one unseen.
    """
    shards = shards or int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    three = stage(_count_trigrams(texts, shards), "trigrams", "kind")
    two = stage(_count_bigrams(three, shards), "bigrams", "kind")
    release(three, part=f"kind={PARTS}")
    settle(texts.sparkSession)
    one = stage(_count_words(two), "words", "kind")
    release(two, part=f"kind={PARTS}")
    settle(texts.sparkSession)
    discounts, totals = [], []
    for part in (one, two, three):
        rows = part.where(F.col("kind") == LEVELS).select("data").collect()  # a row of six numbers for each shard
        n = sum((unpacked(bytes(r.data))[1].astype(np.int64) for r in rows), np.zeros(6, np.int64))
        discounts.append(_discounts(*n[:4].astype(float)))
        totals.append(n)
    n = totals[0]
    d = discounts[0]
    left = d[0] * n[0] + d[1] * n[1] + d[2] * (n[4] - n[0] - n[1])
    spare = left / max(1, n[5]) / (n[4] + 1) if n[5] else 1.0
    known = [part.where(F.col("kind").between(TRIGRAMS, WORDS)).select("shard", "kind", "data") for part in (one, two, three)]
    tables = bucketed(known[0].unionByName(known[1]).unionByName(known[2]), "model", "shard", shards)
    release(one, two, three)
    settle(texts.sparkSession)
    return Model(shards, tuple(discounts), float(n[5]), float(spare), _filter(tables, shards), tables)


class Grams(NamedTuple):
    """Keys in documents that begin with two starts; `at` are the places of words, before which stand contexts."""

    words: np.ndarray
    pairs: np.ndarray
    triples: np.ndarray  # of the words only
    at: np.ndarray


def _grams(words: np.ndarray, size: np.ndarray) -> Grams:
    ends = np.cumsum(size + 2)
    at = np.delete(np.arange(ends[-1] if len(ends) else 0), np.concatenate((ends - size - 2, ends - size - 1))) if len(ends) else np.zeros(0, np.int64)
    every = np.zeros(len(words) + 2 * len(size), _U)
    every[at] = words
    before = np.concatenate((every[:1], every[:-1]))
    before[ends - size - 2] = 0
    both = pair(before, every)
    return Grams(mixed(every), both, _triple(both[at - 1], words), at)


def _wanted(own: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct keys that are asked for, by shard and key, and where each shard begins."""
    shard = _shard(own, m.shards)
    bit = _slot(own, shard, m.shards)
    wanted = np.flatnonzero(m.filter[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1)
    order, at = _cut(shard[wanted], m.shards)
    return wanted[order], at


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list, list, np.ndarray, np.ndarray]]:
    """(number, ids, languages, row keys, words, documents) of blocks of rows (doc_id, lang, text, row_key)."""
    base, seen = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, 0
    ids, langs, keys, words, doc, held = [], [], [], [], [], 0
    for batch in batches:
        every, tongues, rows = (batch.column(k).to_pylist() for k in (0, 1, 3))
        for i, j, w, d in word_hashes(batch.column(2)):
            words.append(w >> WORD_BITS)
            doc.append(d - i + len(ids))
            ids += every[i:j]
            langs += tongues[i:j]
            keys += rows[i:j]
            held += len(w)
            if held >= BLOCK:
                yield base + seen, ids, langs, keys, np.concatenate(words), np.concatenate(doc)
                ids, langs, keys, words, doc, held, seen = [], [], [], [], [], 0, seen + 1
    if ids:
        yield base + seen, ids, langs, keys, np.concatenate(words), np.concatenate(doc)


def _found(tables: dict[int, np.ndarray], kind: int, keys: np.ndarray) -> list[np.ndarray]:
    """Counts of keys in one table of a shard, 0 where it doesn't hold them."""
    width = {TRIGRAMS: 1, CONTEXTS: 4, BIGRAMS: 1, WORDS: 5}[kind]
    if kind not in tables or not tables[kind].shape[1]:
        return [np.zeros(len(keys), np.int64)] * width
    own = tables[kind]
    at = np.minimum(np.searchsorted(own[0], keys), own.shape[1] - 1)
    return [np.where(own[0][at] == keys, x[at], _U(0)) for x in own[1:]]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, n_words, log_perplexity, row_key) of docs (doc_id, lang, text, row_key); null without words.

    Documents come in ROUNDS parts by their row_key. Each part is read once: its blocks write what
    they ask of the shards beside their coded words, the shards answer, and each block scores its
    own; then what was written for it goes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model._replace(tables=None))  # FILTER_BITS / 8 bytes
    parts = [_scored(docs.where(F.pmod("row_key", F.lit(ROUNDS)) == r), model, shared) for r in range(ROUNDS)]
    release(model.tables)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _scored(docs: DataFrame, model: Model, shared: Broadcast) -> DataFrame:
    """The scores of one part of the documents, written."""
    kinds = {"shard": pa.int32(), "block": pa.int64(), "words": pa.binary(), "pairs": pa.binary(), "triples": pa.binary(), "ids": pa.list_(pa.int64()), "langs": pa.list_(pa.string()), "keys": pa.list_(pa.int64())}

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)), kinds.values())], list(kinds))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for block, ids, langs, row_keys, words, doc in _blocks(batches):
            size, asks = np.bincount(doc, minlength=len(ids)), []
            for keys in _grams(words, size)[:3]:
                own = _distinct(keys)
                place, at = _wanted(own, m)
                asks.append((own[place] >> SHARD_BITS, at))
            asked = np.flatnonzero(sum(np.diff(at) for _, at in asks))
            yield frame([(s, block, *(packed(own[at[s] : at[s + 1]]) for own, at in asks), None, None, None) for s in asked.tolist()]) if len(asked) else frame([(0, block, *[packed(np.zeros(0, _U))] * 3, None, None, None)])
            own, at = _vocabulary(words)
            # the block itself has no shard
            yield frame([(None, block, packed(own), packed(np.zeros(len(words)), at), packed(np.zeros(len(ids)), size), ids, langs, row_keys)])

    def answer(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
        give_back()
        held = {kind: unpacked(data.as_py()) for kind, data in zip(known.column("kind").to_pylist(), known.column("data"))}
        out = []
        for i in range(asked.num_rows):
            words, pairs, triples = (unpacked(asked.column(c)[i].as_py())[0] for c in ("words", "pairs", "triples"))
            told = [np.stack(x) for x in (_found(held, WORDS, words), _found(held, BIGRAMS, pairs) + _found(held, CONTEXTS, pairs), _found(held, TRIGRAMS, triples))]
            out.append((key[0].as_py(), asked.column("block")[i].as_py(), *(packed(np.zeros(x.shape[1]), *x) for x in told)))
        cols = list(zip(*out)) or [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds.values())], list(kinds)[:5])

    def judge(texts: pa.Table, told: pa.Table) -> pa.Table:
        give_back()
        m = shared.value
        ids, langs = texts.column("ids")[0].as_py(), texts.column("langs")[0].as_py()
        size = unpacked(texts.column("triples")[0].as_py())[1].astype(np.int64)
        own = unpacked(texts.column("words")[0].as_py())[0]
        words = own[unpacked(texts.column("pairs")[0].as_py())[1].astype(np.int64)]
        order = np.argsort(told.column("shard").to_numpy())
        grams = _grams(words, size)

        def told_of(kind: str, keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
            own, at = np.unique(keys, return_inverse=True)
            full = np.zeros((width, len(own)))
            got = [unpacked(told.column(kind)[int(i)].as_py())[1:] for i in order]
            if got:
                full[:, _wanted(own, m)[0]] = np.concatenate(got, 1)
            return full, at

        less = lambda c, d: np.maximum(c - np.choose(np.minimum(c, 3).astype(np.int8), (0.0, *d)), 0)
        kept = lambda parts, d: sum(x * y for x, y in zip(parts, d))
        (d1, d2, d3), at = m.discounts, grams.at
        (ends, starts, *by), back = told_of("words", grams.words, 5)
        last, first = back[at], back[at - 1]
        p = (less(ends, d1) / max(1.0, m.ends) + m.spare)[last]
        given, left = starts[first], kept(by, d2)[first]
        (tail, total, *mine), back = told_of("pairs", grams.pairs, 5)
        tails, context = back[at], back[at - 1]
        p = np.where(given > 0, (less(tail, d2)[tails] + left * p) / np.maximum(given, 1), p)
        given, left = total[context], kept(mine, d3)[context]
        (seen,), back = told_of("triples", grams.triples, 1)
        p = np.where(given > 0, (less(seen, d3)[back] + left * p) / np.maximum(given, 1), p)
        mean = -np.bincount(np.repeat(np.arange(len(ids)), size), np.log(p), len(ids)) / np.maximum(size, 1)
        cols = (pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(size, pa.int64()), pa.array(mean, pa.float64(), mask=size == 0), pa.array(texts.column("keys")[0].as_py(), pa.int64()))
        return pa.table(list(cols), ["doc_id", "lang", "n_words", "log_perplexity", "row_key"])

    answers = "shard int, block long, words binary, pairs binary, triples binary"
    both = docs.mapInArrow(ask, f"{answers}, ids array<long>, langs array<string>, keys array<long>").withColumn("part", F.when(F.col("shard").isNull(), 0).otherwise(1))
    written = stage(both, "asked", "part")
    asked = written.where("part = 1").select("shard", "block", "words", "pairs", "triples")
    told = stage(asked.groupBy("shard").cogroup(model.tables.groupBy("shard")).applyInArrow(answer, answers), "answers")
    release(written, part="part=1")
    settle(docs.sparkSession)
    texts = written.where("part = 0").drop("part", "shard")
    scored = stage(texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(judge, "doc_id long, lang string, n_words long, log_perplexity double, row_key long"), "scored")
    release(told, written)
    del both, asked, told, texts, written
    settle(docs.sparkSession)
    return scored


def bars_by_language(scored: DataFrame, level: float, least: int) -> DataFrame:
    """(lang, bar): the log perplexity that best parts held-out documents by label, and of all languages under null.

    Of the bars between two values, that with the largest share of rejected documents of quality 0
    (trusted false) less the share of rejected good ones (trusted true). Where none is better than
    chance, or without quality 0, the `level` quantile of the good ones. A language with fewer than
    `least` documents of either quality has no bar of its own. Counts by bins of 0.001 stand for
    the values, so that any number of rows gives one answer.
    """
    rows = scored.where("trusted IS NOT NULL AND log_perplexity IS NOT NULL").select("lang", "trusted", F.ceil(F.col("log_perplexity") * 1000).alias("bin"))
    both = rows.where("lang IS NOT NULL").unionByName(rows.withColumn("lang", F.lit(None).cast("string")))
    counts = both.groupBy("lang", "bin").agg(F.count_if("trusted").alias("good"), F.count_if(~F.col("trusted")).alias("bad"))
    mine = Window.partitionBy("lang")
    upto, ahead = mine.orderBy("bin"), F.lead("bin").over(mine.orderBy("bin"))
    for kind in ("good", "bad"):
        counts = counts.withColumn(f"{kind}s", F.sum(kind).over(mine)).withColumn(f"{kind}_kept", F.sum(kind).over(upto))
    counts = counts.withColumn("ahead", F.coalesce(ahead, "bin"))
    counts = counts.where(F.col("goods") > 0).where(F.col("lang").isNull() | (F.least("goods", "bads") >= least))
    parted = F.col("good_kept") * F.col("bads") - F.col("bad_kept") * F.col("goods")
    best = F.max(F.struct(parted.alias("parted"), (-F.col("bin")).alias("lower"), "ahead"))
    quantile = F.min(F.when(F.col("good_kept") >= level * F.col("goods"), F.col("bin")))
    found = counts.groupBy("lang").agg(best.alias("best"), quantile.alias("quantile"))
    middle = (F.col("best.ahead") - F.col("best.lower")) / 2
    return found.select("lang", (F.when(F.col("best.parted") > 0, middle).otherwise(F.col("quantile")) / 1000).alias("bar"))


def classify(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", level=0.95, least=10, held=10) -> DataFrame:
    """Judge documents by their perplexity under a model of trusted text (labels of quality 1).

    One trusted document in `held`, by a hash of its id, is held out of training; those labelled
    0 are never in it. A document is kept while its log perplexity is at most the bar that best
    parts the held-out good from the bad of its language (see bars_by_language); a language with
    few of either, or null, takes the bar of all. Without any good held-out document everything
    with words is kept.

    Returns doc_id, row_key (see shared.rows_of), n_words, log_perplexity, bar, keep. Null or wordless text has no perplexity
    and is not kept; labels of null quality or id don't count, an id labelled both ways is
    neither; rows that repeat are judged alike; an empty table gives no rows.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("quality").alias("most"))
    known = stage(known.where("q = most AND q IN (0, 1)").select("doc_id", (F.col("q") == 1).alias("trusted")), "known")
    if known.count() <= BROADCAST_IDS:
        known = F.broadcast(known)
    docs = keyed(docs)
    rows = rows_of(docs, doc_id=F.col(id_col).cast("long"), lang=F.col(lang_col).cast("string"), text=F.col(text_col).cast("string"))
    aside = F.pmod(F.xxhash64("doc_id"), F.lit(held)) == 0
    model = train(rows.join(known.where("trusted"), "doc_id").where(~aside).select("text"), shards_for(docs))
    scored = score(rows, model).join(known.where(aside | ~F.col("trusted")), "doc_id", "left")
    bars = stage(bars_by_language(scored, level, least), "bars")
    whole = bars.where("lang IS NULL").select(F.col("bar").alias("any"), F.lit(1).alias("one"))
    judged = scored.join(F.broadcast(bars.where("lang IS NOT NULL")), "lang", "left").withColumn("one", F.lit(1)).join(F.broadcast(whole), "one", "left")
    bar = F.coalesce("bar", "any", F.lit(float("inf")))
    return judged.select("doc_id", "row_key", "n_words", "log_perplexity", bar.alias("bar"), F.coalesce(F.col("log_perplexity") <= bar, F.lit(False)).alias("keep"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
