"""Phrases of words that occur together more often than their parts would: counts by multikey quicksort of routed suffixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import key_filter, release, stage, table
from .textgrams import LOWER, binary_view, give_back, mixed, packed, pair, unpacked

_U = np.uint64
#: Text of one language that is counted together before anything is sent.
BLOCK = 8 << 20
#: Suffixes that a shard holds, about.
SHARD_ROWS = 1 << 20
#: What ends a piece, and what ends a word besides.
BREAK, BLANK = np.zeros(256, bool), np.zeros(256, bool)
BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
BLANK[[9, 32]] = True
#: Pivots are drawn with it, so that no order of the rows makes the sort slow.
SEED = 11


def multikey_counts(keys: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent whole rows of keys (depth x rows): a row number and the weight of all rows like it, for each.

    Three-way multikey quicksort of all segments at once. A segment holds rows whose first
    `depth` words agree; a pivot parts it by the next word into rows below, equal and above, and
    the equal ones go on one word deeper. The size of an equal part at full depth is the count;
    parts of less than `least` in sum are abandoned with all that is in them.
    """
    deep = len(keys)
    rows, rng = np.arange(keys.shape[1]), np.random.default_rng(SEED)
    start, depth = np.zeros(1, np.int64), np.zeros(1, np.int64)
    if not len(rows) or weights.sum() < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, totals = [], []
    while len(rows):
        many = np.diff(np.append(start, len(rows)))
        pivot = keys[depth, rows[start + (rng.random(len(start)) * many).astype(np.int64)]]
        word = keys[np.repeat(depth, many), rows] if len(start) > 1 else keys[depth[0], rows]
        middle = np.repeat(pivot, many)
        kind = (word > middle).astype(np.int8) + (word >= middle)
        part = np.add(np.repeat(3 * np.arange(len(start)), many), kind, dtype=np.int64)
        size = np.bincount(part, minlength=3 * len(start))
        rows = rows[_stable_places(kind, start, many, size)]
        begin = np.cumsum(size) - size
        full = np.flatnonzero(size)
        weight = np.add.reduceat(weights[rows], begin[full])
        equal = full % 3 == 1
        next_depth = depth[full // 3] + equal
        done = equal & (next_depth == deep) & (weight >= least)
        found.append(rows[begin[full[done]]])
        totals.append(weight[done])
        on = (weight >= least) & (next_depth < deep)
        size, depth = size[full[on]], next_depth[on]
        rows = rows[np.repeat(on, np.diff(np.append(begin[full], len(rows))))]
        start = np.cumsum(size) - size
    return np.concatenate(found), np.concatenate(totals)


def _stable_places(kind: np.ndarray, start: np.ndarray, many: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The order that puts each segment's rows of kind 0, 1 and 2 one after another, as they came."""
    begin = (np.cumsum(size) - size).reshape(-1, 3)
    order = np.empty(len(kind), np.int64)
    for k in range(3):
        own = kind == k
        before = np.cumsum(own)
        at = np.flatnonzero(own)
        base = begin[:, k] - (before[start] - own[start])
        order[np.repeat(base, many)[at] + before[at] - 1] = at
    return order


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    """Texts by language, about BLOCK bytes at a time; null language is und, null text empty."""
    for batch in batches:
        lang = pc.fill_null(batch.column(0).cast(pa.string()), "und").dictionary_encode()
        for k, name in enumerate(lang.dictionary.to_pylist()):
            own = batch.column(1).filter(pc.equal(lang.indices, k))
            size = np.cumsum(np.asarray(pc.binary_length(own).fill_null(0)).astype(np.int64))
            edges = [0, *(np.flatnonzero(np.diff(size // BLOCK)) + 1).tolist(), len(own)]
            for i, j in zip(edges, edges[1:]):
                yield name, own[i:j]
        give_back()


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Ids of lower-cased words, the distinct words, and the piece of each word."""
    data, at = binary_view(texts.cast(pa.string()))
    data, at = LOWER[data[at[0] : at[-1]]], at - at[0]
    stop = BREAK[data]
    ink = ~(stop | BLANK[data])
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(ink & (edge[:-1] | ~np.concatenate(([False], ink[:-1]))))
    ends = np.flatnonzero(ink & (edge[1:] | ~np.concatenate((ink[1:], [False])))) + 1
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[ink])).dictionary_encode()
    piece = np.cumsum(stop | edge[:-1], dtype=np.int32)[starts]
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary, piece


def word_keys(lang: str, words: pa.Array) -> np.ndarray:
    """A 64-bit key of each word of a language."""
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words.cast(pa.binary()).to_pylist()), _U, len(words))


def _held(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = keys % _U(8 * len(bits))
    return (bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8) & 1).astype(bool)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, key, f): occurrences of each word of each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _blocks(batches):
            ids, words, _ = _words(texts)
            if len(words):
                f = np.bincount(ids, minlength=len(words))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), words.cast(pa.string()), pa.array(word_keys(lang, words).view(np.int64)), pa.array(f.astype(np.int64))], ["lang", "word", "key", "f"])

    parts = docs.mapInArrow(count, "lang string, word string, key long, f long")
    return parts.groupBy("lang", "word").agg(F.first("key").alias("key"), F.sum("f").alias("f"))


def _phrase_keys(words: list[np.ndarray]) -> np.ndarray:
    """A key of each sequence of words."""
    key = words[0]
    for w in words[1:]:
        key = pair(key, w)
    return key


def suffix_counts(docs: DataFrame, depth: int, least: int, held: np.ndarray, expected: int) -> DataFrame:
    """(lang, w1 to w<depth>, key, f) of all phrases of `depth` words that occur `least` times or more.

    held has a bit for each frequent phrase of one word less. A suffix of a piece, cut to `depth`
    words, counts only where both phrases inside it may be frequent, else it can't be so itself;
    `expected` is a bound on how many there are. Suffixes alike in a block of text go as one with
    their number to shards, by a hash of their leading words, so that a common word is no hot key;
    each shard sorts its own.
    """
    bits, shards = docs.sparkSession.sparkContext.broadcast(held), max(1, -(-expected // SHARD_ROWS))
    names = [f"w{k}" for k in range(1, depth + 1)]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _blocks(batches):
            ids, words, piece = _words(texts)
            n = len(ids) - depth + 1
            if n < 1:
                continue
            known = word_keys(lang, words)
            often = _held(_phrase_keys([known[ids[k : n + 1 + k]] for k in range(depth - 1)]), bits.value)
            at = np.flatnonzero(often[:-1] & often[1:] & (piece[:n] == piece[depth - 1 :]))
            # numbers of the distinct suffixes, one word deeper each time
            code = ids[at]
            for k in range(1, depth):
                code = np.unique(code * len(words) + ids[at + k], return_inverse=True)[1] if k < depth - 1 else code * len(words) + ids[at + k]
            _, first, count = np.unique(code, return_index=True, return_counts=True)
            keys = [known[ids[at[first] + k]] for k in range(depth)]
            shard = (mixed(_phrase_keys(keys)) % _U(shards)).astype(np.int32)
            order = np.lexsort((*keys[::-1], shard))
            cut = np.searchsorted(shard[order], np.arange(shards + 1))
            filled = np.flatnonzero(np.diff(cut))
            columns = [c[order] for c in (*keys, count)]
            data = [packed(*(c[cut[s] : cut[s + 1]] for c in columns)) for s in filled.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array([lang] * len(data), pa.string()), pa.array(data, pa.binary())], ["shard", "lang", "data"])

    def sort(group: pa.Table) -> pa.Table:
        parts = [unpacked(x) for x in group.column("data").to_pylist()]
        langs = group.column("lang").combine_chunks().dictionary_encode()
        columns = np.concatenate(parts, 1)
        first, total = multikey_counts(columns[:-1], columns[-1].astype(np.int64), least)
        of = np.searchsorted(np.cumsum([x.shape[1] for x in parts]), first, "right")
        lang = langs.take(pa.array(of)) if isinstance(langs, pa.Array) else langs.combine_chunks().take(pa.array(of))
        words = [c[first] for c in columns[:-1]]
        give_back()
        return pa.table([lang.cast(pa.string()), *(pa.array(w.view(np.int64)) for w in words), pa.array(_phrase_keys(words).view(np.int64)), pa.array(total)], ["lang", *names, "key", "f"])

    routed = docs.mapInArrow(route, "shard int, lang string, data binary")
    return routed.groupBy("shard").applyInArrow(sort, ", ".join(["lang string", *(f"{c} long" for c in names), "key long", "f long"]))


def _scored(tables: dict[int, DataFrame], m: int) -> DataFrame:
    """Phrases of m words with their text and their lowest-scoring cut: (lang, words, a, phrase, best)."""
    words = [f"w{k}" for k in range(1, m + 1)]
    out = tables[m].select("lang", *words, F.col("f").alias("a"))
    cuts = []
    wide = "cast({} AS decimal(15,0))".format  # products pass 64 bits
    for k in range(1, m):
        first, rest = tables[k], tables[m - k]
        first = first.select(*[F.col(f"w{i}") for i in range(1, k + 1)], F.col("f").alias(f"l{k}"), *([F.col("phrase").alias("first")] if k == m - 1 else []))
        rest = rest.select(*[F.col(f"w{i}").alias(f"w{i + k}") for i in range(1, m - k + 1)], F.col("f").alias(f"r{k}"), *([F.col("phrase").alias("last")] if k == m - 1 else []))
        out = out.join(first, words[:k]).join(rest, words[k:])
        score = F.expr(f"({wide('a')} * {wide('a')} * 1000000) div ({wide(f'l{k}')} * {wide(f'r{k}')})")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    return out.select("lang", *words, "a", F.concat("first", F.lit(" "), "last").alias("phrase"), (F.array_min(F.array(*cuts)) if len(cuts) > 1 else cuts[0]).alias("best"))


def mine_phrases(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", least: int = 10, longest: int = 3, share: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to `longest` words.

    Texts in lower case (A-Z) part into pieces at .,;:!? and line ends, pieces into words at blanks
    and tabs. A phrase is in question if it occurs `least` times (a); of its cuts in two, that of the
    lowest score floor(1000000 a a / (l r)) counts, l and r being how often its parts occur. One
    whose words lie in a longer phrase in question that occurs `share` percent as often is left out.
    n is the number of words. Words have keys of 64 bits. Null language is und; null text is empty; repeats count as often; an empty table
    gives no rows; other columns are not looked at. Each depth routes only what the one before left.
    """
    docs = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    every = stage(word_counts(docs), "words")
    held = key_filter(every.where(F.col("f") >= least).select("key"))
    tables = {1: every.where(F.col("f") >= least).select("lang", F.col("key").alias("w1"), F.col("word").alias("phrase"), "f")}
    staged, scored = [every], {}
    expected = every.where(F.col("f") >= least).agg(F.sum("f")).first()[0] or 0
    for m in range(2, longest + 1):
        own = stage(suffix_counts(docs, m, least, held, expected), f"phrases-{m}")
        tables[m] = own
        scored[m] = stage(_scored(tables, m), f"scored-{m}")
        words = [f"w{k}" for k in range(1, m + 1)]
        tables[m] = scored[m].select("lang", *words, "phrase", F.col("a").alias("f"))
        staged += [own, scored[m]]
        if m < longest:
            held, expected = key_filter(own.select("key")), own.agg(F.sum("f")).first()[0] or 0
    kept = []
    for m, own in scored.items():
        if m + 1 in scored:
            # what lies in a longer phrase lies in one of one word more that occurs no less
            words, longer = [f"w{k}" for k in range(1, m + 1)], scored[m + 1]
            inner = [longer.select(*[F.col(f"w{k + d}").alias(f"w{k}") for k in range(1, m + 1)], F.col("a").alias("longer")) for d in (0, 1)]
            most = inner[0].unionByName(inner[1]).groupBy(*words).agg(F.max("longer").alias("longer"))
            own = own.join(most, words, "left").where(f"longer IS NULL OR 100 * longer < {share} * a")
        kept.append(own.select("lang", "phrase", "a", "best.l", "best.r", "best.score"))
    found = kept[0]
    for more in kept[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    total = every.groupBy("lang").agg(F.sum("f").alias("n"))
    out = stage(ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "ranked-phrases")
    release(*staged)
    return out


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


def oracle() -> str:
    return r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), ws AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), f1 AS (
  SELECT lang, w1, count(*) AS f FROM (SELECT lang, unnest(w) AS w1 FROM ws) GROUP BY ALL
), f2 AS (
  SELECT lang, w1, w2, count(*) AS f FROM (SELECT lang, unnest(w[:-2]) AS w1, unnest(w[2:]) AS w2 FROM ws WHERE len(w) > 1) GROUP BY ALL
), f3 AS (
  SELECT lang, w1, w2, w3, count(*) AS f FROM (SELECT lang, unnest(w[:-3]) AS w1, unnest(w[2:-2]) AS w2, unnest(w[3:]) AS w3 FROM ws WHERE len(w) > 2) GROUP BY ALL HAVING count(*) >= 10
), two AS (
  SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, p.f AS a, x.f AS l, y.f AS r, p.f::HUGEINT * p.f * 1000000 // (x.f::HUGEINT * y.f) AS score
  FROM f2 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w2
  WHERE p.f >= 10 AND NOT EXISTS (SELECT 1 FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) q WHERE q.lang = p.lang AND q.w1 = p.w1 AND q.w2 = p.w2 AND 100 * q.f >= 50 * p.f)
), cuts AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a, a1.f AS l1, b1.f AS r1, a2.f AS l2, b2.f AS r2,
    t.f::HUGEINT * t.f * 1000000 // (a1.f::HUGEINT * b1.f) AS s1, t.f::HUGEINT * t.f * 1000000 // (a2.f::HUGEINT * b2.f) AS s2
  FROM f3 t JOIN f1 a1 ON a1.lang = t.lang AND a1.w1 = t.w1 JOIN f2 b1 ON b1.lang = t.lang AND b1.w1 = t.w2 AND b1.w2 = t.w3
  JOIN f2 a2 ON a2.lang = t.lang AND a2.w1 = t.w1 AND a2.w2 = t.w2 JOIN f1 b2 ON b2.lang = t.lang AND b2.w1 = t.w3
), every AS (
  SELECT * FROM two UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cuts
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM every
)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, n.n::BIGINT AS n, k.score::BIGINT AS score
FROM ranked k JOIN (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang) n USING (lang) WHERE k.rank <= 2000
"""
