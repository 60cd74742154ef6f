"""Runs of words against plain search for every period."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import runs as R
from tessera.llm.runs import op12_periodic_runs, periodic_runs, runs_of, with_period

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=12):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, 2 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i) + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def plain_row(doc_id, text):
    words = planted(doc_id, text)
    found = plain_runs(words)
    drop = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    return (doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], digest(lines), digest(" ".join(w for i, w in enumerate(words) if i not in drop)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 20), st.integers(0, 40)), max_size=5))
def test_runs_equal_plain_search(texts):
    ids = [[*x, *([x[-p:] * 9][0][:extra] if x else [])] for x, p, extra in texts]
    sizes = np.array([len(x) for x in ids], np.int64)
    starts = np.cumsum(sizes) - sizes
    got = runs_of(np.array(sum(ids, []), np.int32), starts, sizes, 12).tolist()
    assert got == [[int(b) + s, n, p] for x, b in zip(ids, starts) for s, n, p in plain_runs(x)]


@pytest.mark.parametrize("seed", range(6))
def test_long_texts_come_in_parts(monkeypatch, seed):
    monkeypatch.setattr(R, "GRID", 16)
    monkeypatch.setattr(R, "PAIRS", 200)
    monkeypatch.setattr(R, "_tables", {})
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 2, 700)
    x[100:] = x[100 + np.arange(600) % 57]
    assert runs_of(x.astype(np.int32), np.array([0]), np.array([700]), 12).tolist() == [list(r) for r in plain_runs(x.tolist())]


def test_odd_rows(spark):
    """Nulls, empty and blank texts, repeated ids, one very long text of one word, other columns and marks between words."""
    long_text = "na " * 120_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b " * 7), (5, "a b " * 7), (5, "a b " * 7), (6, long_text), (7, "é ü x\n" * 6), (8, "A a " * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit("x"))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect()]
    assert sorted(got, key=str) == sorted([
        (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (None, 14, [(0, 14, 2)], "a b"), (5, 14, [(0, 14, 2)], "a b"), (5, 14, [(0, 14, 2)], "a b"),
        (6, 120_000, [(0, 120_000, 1)], "na"), (7, 12, [(0, 12, 2)], "é ü x"), (8, 12, [(0, 12, 2)], "A a"),
    ], key=str)
    assert periodic_runs(docs.limit(0)).count() == 0


def test_planted_periods(spark):
    rows = [(i, " ".join(f"w{j * i % 7}" for j in range(i % 40))) for i in range(300)] + [(None, "a b c"), (13, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text): r.after for r in docs.withColumn("after", with_period(F.col("text"), F.col("doc_id"))).collect()}
    for (doc_id, text), after in got.items():
        want = planted(doc_id, text) if doc_id is not None else WORD.findall(text)
        assert WORD.findall(after or "") == want


def test_query_against_plain_search(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(int(i), " ".join(f"w{k}" for k in rng.integers(0, rng.integers(1, 40), rng.integers(0, 150)))) for i in range(400)]
    rows += [(9001, None), (9002, ""), (9003, "x " * 500)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in op12_periodic_runs(spark, str(tmp_path)).collect())
    assert got == sorted(plain_row(*r) for r in rows)
    assert sum(r[1] > 0 for r in got) > 30
