"""Packing by minimum bin slack: ids against whole texts, windows against all subsets."""

import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import slack as S
from tessera.llm.slack import ChunkCoder, Windows, fullest, op13_minimum_bin_slack, pack_windows, tokenizer_path

TOKENIZER = Tokenizer.from_file(tokenizer_path())
CODER = ChunkCoder(tokenizer_path())
ALPHABET = "aZéß中́ \t\n\r\x0b\x1c  　.,'\"!09١<|>-_st re\x00\U0001f600"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(ALPHABET, max_size=40), st.text(max_size=12), st.sampled_from(["don't 's '' 'll I'LL", "a<|endoftext|>b", "x  y\n\n z", "x \n"])), max_size=5))
def test_ids_equal_whole_texts(texts):
    flat, at = CODER.encode(pa.array(texts, pa.string()))
    assert [flat[a:b].tolist() for a, b in itertools.pairwise(at.tolist())] == [TOKENIZER.encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=9), st.integers(0, 90))
def test_fullest_equals_all_subsets(items, room):
    counts = Counter(items)
    best, taken = fullest(counts, sorted(counts), room)
    assert best == max(s for n in range(len(items) + 1) for c in itertools.combinations(items, n) if (s := sum(c)) <= room)
    assert best == sum(k * n for k, n in taken) and all(n <= counts[k] for k, n in taken)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=60))
def test_windows_are_full_or_powers(items):
    windows = Windows(64, 5)
    for i, n in enumerate(items):
        windows.add(n, i, 0)
    rows = windows.fill(200) + windows.finish()
    fills, covered = defaultdict(int), defaultdict(list)
    for doc, start, length, sequence, offset in rows:
        assert offset == fills[sequence] and length > 0
        fills[sequence] += length
        covered[doc].append((start, length))
    assert all(n & (n - 1) == 0 and n <= 64 for n in fills.values()) and sum(n < 64 for n in fills.values()) <= 6
    for doc, parts in covered.items():
        assert [s for s, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1]]
    assert {d: sum(n for _, n in p) for d, p in covered.items()} == dict(enumerate(items))


def whole(rows, texts):
    """Rows hold each id of each text once, in sequences without padding."""
    pieces, fill = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= 2048
    want = Counter()
    for doc, text in texts:
        ids = np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want[doc, len(ids)] += 1
        own = sorted(pieces[doc, len(ids)])
        for start, length, crc in own:
            assert zlib.crc32(ids[start : start + length].tobytes()) == crc
        if want[doc, len(ids)] == 1 and sum(1 for d, t in texts if d == doc) == 1:
            assert [p[0] for p in own] == [0, *np.cumsum([p[1] for p in own])[:-1]] and sum(p[1] for p in own) == len(ids)
    assert sum(r.length for r in rows) == sum(n * k for (_, n), k in want.items())
    return fill


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "WAITING", 5000)
    rows = [(1, None), (2, ""), (None, "no id"), (3, "twice"), (3, "twice"), (4, "a very long text, " * 40_000)] + [(10 + i, "word " * (i * 37 % 900)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"length": F.lit("x"), "start": F.lit(None)}).repartition(3)
    fill = whole(pack_windows(docs).collect(), rows)
    assert sum(sum(n for _, n in p) < 2048 for p in fill.values()) <= 33
    assert pack_windows(docs.limit(0)).count() == 0


def test_query(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 90, rng.integers(0, 3000)))) for i in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    whole(op13_minimum_bin_slack(spark, str(tmp_path)).collect(), rows)
