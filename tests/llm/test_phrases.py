"""Phrases against SQL and plain counting."""

import re
from collections import Counter
from functools import reduce

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import phrases as P
from tessera.llm.phrases import mine_phrases, multikey_counts, op11_phrase_collocations, oracle


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 3), st.integers(0, 6), st.lists(st.tuples(*[st.integers(0, 4)] * 3, st.integers(1, 5)), max_size=60))
def test_multikey_counts_equal_plain_counts(depth, least, rows):
    keys = np.array([r[:depth] for r in rows], np.uint64).reshape(len(rows), depth).T
    weights = np.array([r[3] for r in rows], np.int64)
    first, total = multikey_counts(keys, weights, least)
    want = Counter()
    for r in rows:
        want[r[:depth]] += r[3]
    got = {tuple(keys[:, i].tolist()): t for i, t in zip(first.tolist(), total.tolist())}
    assert len(got) == len(first) and got == {k: n for k, n in want.items() if n >= least}


def plain(rows, least, longest, share, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    asked = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    inside = {}
    for k, a in asked.items():
        for m in range(2, len(k) - 1):
            for i in range(1, len(k) - m + 1):
                sub = (k[0], *k[i : i + m])
                inside[sub] = max(inside.get(sub, 0), a)
    out = []
    for k, a in asked.items():
        if 100 * inside.get(k, 0) >= share * a:
            continue
        score, _, l, r = min((10**6 * a * a // (f[k[: i + 1]] * f[(k[0], *k[i + 1 :])]), i, f[k[: i + 1]], f[(k[0], *k[i + 1 :])]) for i in range(1, len(k) - 1))
        out.append((k[0], -score, -a, " ".join(k[1:]).encode(), l, r))
    ranked, seen = [], Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return ranked


def rows_for(seed, count=150):
    rng = np.random.default_rng(seed)
    words = ["the", "New", "york", "CITY", "é", "a.b", "x,y", "hot", "dog", "\tno\n", "z!"]
    return [(["en", "de", None, "und"][i % 4], " ".join(words[k] for k in rng.zipf(1.5, 40) % len(words))) for i in range(count)] + [("en", None), ("en", ""), (None, " . ,"), ("fr", "only once"), ("en", "hot dog " * 30_000)]


def test_counts_of_four_words_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 4000)
    monkeypatch.setattr(P, "SHARD_ROWS", 300)
    rows = rows_for(1)
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({"word": F.lit(1), "w1": F.lit("x"), "f": F.lit(None)}).repartition(3)
    got = [tuple(r) for r in mine_phrases(docs, least=4, longest=4, share=60, top=25).collect()]
    assert sorted(got) == sorted(plain(rows, 4, 4, 60, 25)) and len(got) > 50
    assert mine_phrases(docs.limit(0)).count() == 0


def test_query_against_sql_and_plain(spark, tmp_path):
    rows = reduce(list.__add__, (rows_for(s, 80) for s in range(3)))
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = op11_phrase_collocations(spark, str(tmp_path)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(oracle()).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) == sorted(plain(rows, 10, 3, 50, 2000)) and len(want) > 20
