"""Runs of repeated words in texts: harmonic grids of word pairs, extended by difference-cover longest common extensions."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .textgrams import SPACE, binary_view, give_back

#: A perfect difference set: any two positions reach places of the cover together after fewer than MODULUS steps.
MODULUS, COVER = 13, (0, 1, 3, 9)
#: Text taken at a time, words of short texts handled together, pairs of a long text at a time.
SEGMENT, GROUP, PAIRS = 1 << 20, 1 << 16, 1 << 20
#: Texts of up to so many words share one table of grid pairs.
GRID = 4096

_in_cover = np.isin(np.arange(MODULUS), COVER)
#: Steps from positions of two residues to the cover.
STEPS = np.array([[next(d for d in range(MODULUS) if _in_cover[(a + d) % MODULUS] and _in_cover[(b + d) % MODULUS]) for b in range(MODULUS)] for a in range(MODULUS)], np.int64)


class Extensions:
    """Longest common extensions to the right of pairs of positions of `words`.

    `words` has whole numbers; each text ends in a number that no other place has, and so do the
    last MODULUS places. A pair is compared word by word until both are in the cover; the rest is
    a minimum over the common prefixes of neighbours in the order of the sampled suffixes.
    """

    def __init__(self, words: np.ndarray):
        self.words, self.rank = words, None

    def near(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal words before the cover, and whether the cover was reached."""
        steps = STEPS[a % MODULUS, b % MODULUS]
        same, left, k = np.zeros(len(a), np.int64), np.flatnonzero(steps > 0), 0
        while len(left):
            left = left[self.words[a[left] + k] == self.words[b[left] + k]]
            k += 1
            same[left] = k
            left = left[steps[left] > k]
        return same, same == steps

    def _sort(self, where: np.ndarray) -> None:
        """Order the cover's suffixes within `where` (a mask of positions), by doubling from cover to cover."""
        words, n = self.words, len(self.words)
        at = np.flatnonzero(where & _in_cover[np.arange(n) % MODULUS])
        at = at[at < n - MODULUS]
        place = np.full(n + MODULUS, -1, np.int64)
        place[at] = np.arange(len(at))
        order = np.lexsort([words[at + k] for k in range(MODULUS - 1, -1, -1)])
        first = words[at[order][:, None] + np.arange(MODULUS)]
        rank = np.empty(len(at), np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], (first[1:] != first[:-1]).any(1))))
        levels, width = [rank], MODULUS
        while len(at) and rank.max() + 1 < len(at):
            after = place[np.minimum(at + width, n)]
            key = rank * (len(at) + 1) + np.where(after >= 0, rank[after] + 1, 0)
            rank = np.unique(key, return_inverse=True)[1]
            levels, width = [*levels, rank], 2 * width
        order = np.argsort(rank)
        a, b = at[order[:-1]], at[order[1:]]
        common = np.zeros(len(a), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            i, j = place[np.minimum(a + common, n)], place[np.minimum(b + common, n)]
            equal = (i >= 0) & (j >= 0)
            equal[equal] = levels[level][i[equal]] == levels[level][j[equal]]
            common[equal] += MODULUS << level
        left = np.arange(len(a))
        while len(left):
            left = left[words[a[left] + common[left]] == words[b[left] + common[left]]]
            common[left] += 1
        least = [common]
        for half in (1 << k for k in range(max(0, len(common).bit_length() - 1))):
            least.append(np.minimum(least[-1][:-half], least[-1][half:]))
        self.place, self.rank, self.least = place, rank, least

    def far(self, a: np.ndarray, b: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Common words from two places of the cover on."""
        out = np.zeros(len(a), np.int64)
        if not len(a):
            return out
        if self.rank is None:
            self._sort(where)
        real = (self.place[a] >= 0) & (self.place[b] >= 0)
        r = np.sort(np.stack([self.rank[self.place[a[real]]], self.rank[self.place[b[real]]]]), 0)
        span = np.frexp((r[1] - r[0]).astype(float))[1] - 1
        found = np.zeros(len(span), np.int64)
        for k in np.unique(span).tolist():
            own = span == k
            found[own] = np.minimum(self.least[k][r[0][own]], self.least[k][r[1][own] - (1 << k)])
        out[real] = found
        return out


def _grid(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i*p, (i+1)*p) below n in order of the second, so that those below a smaller n come first."""
    p = np.arange(1, n)
    many = (n - 1) // p
    period = np.repeat(p, many)
    right = period * (np.arange(len(period)) - np.repeat(np.cumsum(many) - many, many) + 1)
    order = np.argsort(right, kind="stable")
    return (right - period)[order].astype(np.int32), right[order].astype(np.int32)


_tables: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _equal_pairs(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid pairs of equal words, of all periods up to half of each text."""
    if "grid" not in _tables:
        left, right = _grid(GRID)
        _tables["grid"] = left, right, np.searchsorted(right, np.arange(GRID + 1))
    left, right, below = _tables["grid"]
    a, b = [], []
    for s, n in zip(starts.tolist(), sizes.tolist()):
        if n <= GRID:
            own = words[s : s + n]
            i, j = left[: below[n]], right[: below[n]]
            hit = np.flatnonzero(own[i] == own[j])
            i, j = i[hit], j[hit]
            fits = 2 * (j - i) <= n
            a.append(i[fits].astype(np.int64) + s)
            b.append(j[fits].astype(np.int64) + s)
            continue
        p = 1
        while 2 * p <= n:
            many = PAIRS * p // n + 1
            period = np.arange(p, min(p + many, n // 2 + 1))
            each = (n - 1) // period
            q = np.repeat(period, each)
            j = s + q * (np.arange(len(q)) - np.repeat(np.cumsum(each) - each, each) + 1)
            hit = np.flatnonzero(words[j - q] == words[j])
            yield j[hit] - q[hit], j[hit]
            p += many
    if a:
        yield np.concatenate(a), np.concatenate(b)


def _stretches(rows: np.ndarray) -> np.ndarray:
    """Of rows (start, length, period) with the same start and length, that of the smallest period."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return rows[first]


def runs_of(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, length, period) of all runs of texts that lie on end in ids, in order of start and period.

    The texts are either of up to GRID words or a single one, whose pairs come a part at a time.

    A run of period p and length >= 2p holds two neighbours of the grid of p; extending them both
    ways gives the run, whichever of its pairs is taken. A multiple of a run's smallest period
    gives the same stretch, so that the smallest period of each stretch counts.
    """
    long_enough = sizes >= max(2, least)
    starts, sizes = starts[long_enough], sizes[long_enough]
    if not len(starts):
        return np.zeros((0, 3), np.int64)
    # texts, each with an end mark of its own, between marks
    source = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    begin = MODULUS + 1 + np.cumsum(sizes + 1) - (sizes + 1)
    n = int(begin[-1] + sizes[-1] + 1) + MODULUS + 1
    words = -1 - np.arange(n, dtype=np.int32)
    words[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(source))] = ids[source]
    forth, back = Extensions(words), Extensions(words[::-1].copy())
    found, text_of = [], lambda x: np.searchsorted(begin, x, "right") - 1
    for a, b in _equal_pairs(words, begin, sizes):
        right, right_on = forth.near(a, b)
        left, left_on = back.near(n - a, n - b)
        kept = np.flatnonzero((right + left >= np.maximum(b - a, least - (b - a))) | right_on | left_on)
        a, b, right, right_on, left, left_on = (x[kept] for x in (a, b, right, right_on, left, left_on))
        where = np.zeros(n, bool)
        for t in np.unique(text_of(a[right_on | left_on])).tolist():
            where[begin[t] - 1 : begin[t] + sizes[t] + 1] = True  # with both marks
        right[right_on] += forth.far(a[right_on] + right[right_on], b[right_on] + right[right_on], where)
        left[left_on] += back.far(n - a[left_on] + left[left_on], n - b[left_on] + left[left_on], where[::-1])
        p = b - a
        whole = right + left >= np.maximum(p, least - p)
        found.append(_stretches(np.stack([a - left, p + right + left, p], 1)[whole]))
    rows = _stretches(np.concatenate(found)) if found else np.zeros((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    text = text_of(rows[:, 0])
    rows[:, 0] += starts[text] - begin[text]
    return rows


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of words, their bytes on end and sizes, and the first word of each text and the end."""
    ink = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(ink & (edge[:-1] | ~np.concatenate(([False], ink[:-1]))))
    ends = np.flatnonzero(ink & (edge[1:] | ~np.concatenate((ink[1:], [False])))) + 1
    sizes = ends - starts
    letters = data[ink]
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
    return np.asarray(coded.indices), letters, sizes, np.searchsorted(starts, at)


def _joined(letters: np.ndarray, sizes: np.ndarray, bounds: np.ndarray, kept: np.ndarray) -> pa.Array:
    """Each text's kept words, joined by one space."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[kept]
    many = sizes[kept]
    space = np.ones(len(many), np.int64)
    space[np.flatnonzero(np.diff(text, prepend=-1))] = 0
    stops = np.cumsum(many + space)
    out = np.full(int(stops[-1]) if len(stops) else 0, 32, np.uint8)
    out[np.repeat(stops - np.cumsum(many), many) + np.arange(many.sum())] = letters[np.repeat(kept, sizes)]
    offsets = np.concatenate(([0], stops))[np.searchsorted(text, np.arange(len(bounds)))]
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def _segments(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, at = binary_view(texts)
    i = 0
    while i < len(texts):
        j = min(max(i + 1, int(np.searchsorted(at, at[i] + SEGMENT, "right")) - 1), len(texts))
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """(id, n_words, runs, collapsed) of each row of docs.

    runs: every stretch of words with smallest period q and at least max(least, 2q) words that
    can't be extended, as structs (start, length, period) by start and period. collapsed: the
    words that no run holds after its first q, joined by one space. Null text has no words; null
    and repeated ids keep their rows; no rows give none; other columns are not looked at. Texts
    are handled where they lie, whole; nothing is shuffled.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in _segments(batch.column(1)):
                ids, letters, sizes, bounds = _words(data, at)
                many = np.diff(bounds)
                group = np.stack([(np.cumsum(many) - many) // GROUP, np.cumsum(many > GRID), np.cumsum(np.concatenate(([0], many[:-1] > GRID)))])
                edges = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1).tolist(), j - i]
                rows = np.concatenate([np.zeros((0, 3), np.int64), *(runs_of(ids, bounds[b:e], many[b:e], least) for b, e in itertools.pairwise(edges))])
                change = np.zeros(len(ids) + 1, np.int64)
                np.add.at(change, rows[:, 0] + rows[:, 2], 1)
                np.add.at(change, rows[:, 0] + rows[:, 1], -1)
                text = np.searchsorted(bounds, rows[:, 0], "right") - 1
                columns = [pa.array(c) for c in (rows[:, 0] - bounds[text], rows[:, 1], rows[:, 2])]
                ends = pa.array(np.searchsorted(text, np.arange(j - i + 1)).astype(np.int32))
                runs = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, fields=list(RUNS.value_type)))
                collapsed = _joined(letters, sizes, bounds, np.cumsum(change[:-1]) == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(many.astype(np.int64)), runs, collapsed], [id_col, "n_words", "runs", "collapsed"])
            give_back()

    return docs.select(id_col, text_col).mapInArrow(find, schema)


def with_period(text: Column, doc_id: Column) -> Column:
    """The text of a tenth of the documents with words repeated from a place on, all of which their id decides.

    Such a text's words come joined by one space. Null ids leave the text as it is.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)) + 1
        unit = F.slice(words, (a + 1).cast("int"), p.cast("int"))
        tail = F.slice(F.flatten(F.array_repeat(unit, 11)), 1, (n - a).cast("int"))
        return F.array_join(F.concat(F.slice(words, 1, a.cast("int")), tail), " ")

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    bound = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise("")), 1)
    return F.when(h % 10 == 0, bound).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", with_period(F.col("text"), F.col("doc_id")).alias("text"))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return periodic_runs(docs).withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.p").alias("period"),
        F.expr("-1000 * best.l div best.p").alias("exponent_milli"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
