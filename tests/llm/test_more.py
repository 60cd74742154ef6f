"""Long and odd input for operators that have short tests elsewhere, and the pipeline's stages."""

import hashlib
import time
import wave
import zlib
from collections import Counter
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import media, neighbours

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(rng.integers(30)) for i in rng.integers(0, len(WORDS), n))


@pytest.mark.parametrize("text", [b"%PDF-1 ", b"%PDF-1 startxref ", b"PK\x03\x04", b"GIF89a!!!!!!!!!", b"GIF89a\x00\x00\x00\x00\x00\x00\x00!\x01\x05abcde", b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR", b"\xff\xd8\xff\xe0\x00\x02", b"\xff\xd8\xff\xda\x00\x02", b"BM", b"RIFF    WAVE"])
def test_validators_take_one_pass(text):
    """Some MB of one magic string, each of which is a candidate."""
    data = text * (3_000_000 // len(text))
    began = time.process_time()
    media.sniff(data, media.automaton())
    assert time.process_time() - began < 20


def test_candidates_that_share_an_end():
    """What validators remember changes no answer: many files on end, in noise, against each alone."""
    zero = b"\x89PNG\r\n\x1a\n" + b"".join(len(b).to_bytes(4, "big") + n + b + zlib.crc32(n + b).to_bytes(4, "big") for n, b in ((b"IHDR", bytes(13)), (b"IDAT", b"x" * 9), (b"IEND", b"")))
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02scan\xff\xd9"
    gif = b"GIF89a" + bytes(7) + b"!\x01\x02ab\x00,\x00\x00\x00\x00\x00\x00\x00\x00\x00\x02\x01x\x00;"
    pdf = b"%PDF-1.4 body startxref 9 %%EOF"
    rng = np.random.default_rng(1)
    for _ in range(60):
        parts, at, want = [], 0, []
        for _ in range(rng.integers(1, 9)):
            for kind, body in [(None, rng.bytes(rng.integers(0, 30)).replace(b"BM", b"..")), [("image/png", zero), ("image/jpeg", jpeg), ("image/gif", gif), ("application/pdf", pdf), (None, b"\xff\xd8\xff\xe0\x00\x04a"), (None, b"GIF87a"), (None, b"%PDF-x")][rng.integers(7)]]:
                if kind:
                    want.append((kind, at, at + len(body)))
                parts.append(body)
                at += len(body)
        got = [tuple(f) for f in media.sniff(b"".join(parts), media.automaton())]
        assert not set(want) - set(got) or any(s < w[1] < e for w in set(want) - set(got) for _, s, e in got)


def test_features_of_stored_media(spark):
    """media_sha256 and feature come from the stored wave file: another reader sees the same samples."""
    texts = [(1, "é" * 400), (2, ""), (3, None), (4, "%PDF-1.4 startxref 1 %%EOF rest"), (4, "%PDF-1.4 startxref 1 %%EOF rest")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"media": F.lit("x"), "declared": F.lit(1)})
    stored = {r.doc_id: bytes(r.media) for r in media.store_payloads(docs).collect()}
    got = media.media_features(media.store_payloads(docs)).collect()
    assert Counter(r.doc_id for r in got) == {1: 1, 2: 1, 3: 1, 4: 2}
    for r in got:
        assert r.media_sha256 == hashlib.sha256(stored[r.doc_id]).hexdigest() and r.media_bytes == len(stored[r.doc_id])
        with wave.open(BytesIO(stored[r.doc_id])) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.getnframes()) == (1, 1, r.payload_bytes)
            assert hashlib.sha256(w.readframes(r.payload_bytes)).hexdigest() == r.payload_sha256
    assert len({r.feature for r in got if r.doc_id == 4}) == 1 and len({r.feature for r in got if r.doc_id in (2, 3)}) == 1


def test_neighbours_score_in_double_precision(spark):
    """Vectors of doubles that floats can't tell apart; fewer candidates than k; repeated ids; clashing columns."""
    base = [1.0, 2.0, 3.0]
    data = [(i, [x + i * 1e-12 for x in base]) for i in range(40)] + [(20, [9.0, 9.0, 9.0])]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumns({"score": F.lit("x"), "rank": F.lit(0), "v": F.lit(1)})
    got = {}
    for r in neighbours.nearest_neighbours(table, block=8, k=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in (0,):
        want = sorted(((-sum(a * b for a, b in zip(data[q][1], v)), i) for i, v in data if i != q), key=lambda t: (t[0], t[1]))
        best, seen = [], set()
        for s, i in want:
            if i not in seen:
                seen.add(i)
                best.append((i, -s))
        assert [(v, pytest.approx(s, abs=1e-13)) for _, v, s in sorted(got[q])] == best[:3]
        assert [v for _, v, _ in sorted(got[q])] == [20, 39, 38]
    few = neighbours.nearest_neighbours(table.where("vec_id < 3"), block=8, k=20).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2)]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row_key long, document int, row int, times int, part int"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with nulls, repeats, empty and long texts and columns named like the stages' own; labels for some."""
    folder = tmp_path_factory.mktemp("corpus")
    good = [(i, prose(i, 60), ["en", "fr", None][i % 3], f"s{i % 3}") for i in range(150)]
    junk = [(1000 + i, " ".join(np.random.default_rng(i).permutation(list("zqxjkvwpy" * 6))), "en", "junk") for i in range(30)]
    odd = [(2000, None, None, None), (2001, "", "en", "s1"), (2002, " \n ", "fr", None), (None, prose(7000, 30), "en", "s0"), (None, prose(7000, 30), "en", "s0"), (2003, prose(1, 60), "en", "s1"), (2004, prose(1, 60) + " more", "en", "s2"), (2005, prose(9, 20_000), "en", "s2"), (2006, "Mail jo.doe@x.org or +1 (456) 555-2186 " + prose(8000, 40), "en", "s0")]
    rows = [(*r, len(r[1] or ""), 1, 2, 3, 4, 5) for r in good + junk + odd]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(folder / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(0, 150, 2)] + [(1000 + i, 0, 0) for i in range(0, 30, 2)] + [(None, 1, 0), (5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def read(spark, corpus):
    return spark.read.parquet(f"{corpus}/documents.parquet")


def test_pipeline_quality_keeps_clean_rows(spark, corpus):
    docs = read(spark, corpus)
    got = corpus_pipeline.quality(spark, docs, corpus)
    assert got.columns == docs.columns
    ids = Counter(r.doc_id for r in got.select("doc_id").collect())
    assert all(ids[i] == 1 for i in range(150)) and not any(1000 <= (i or 0) < 1030 for i in ids)
    assert not ids[2000] and not ids[2001] and not ids[2002]  # they have no words
    assert corpus_pipeline.quality(spark, docs.limit(0), corpus).count() == 0


def test_pipeline_near_duplicates_keeps_one_of_each_group(spark, corpus):
    docs = read(spark, corpus)
    got = corpus_pipeline.near_duplicates(spark, docs, corpus)
    assert got.columns == docs.columns
    ids = Counter(r.doc_id for r in got.select("doc_id").collect())
    assert ids[None] == 1 and sum(ids[i] for i in (1, 2003, 2004)) == 1
    assert all(ids[i] == 1 for i in (0, 2, 2000, 2001, 2002, 2005, 2006))
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), corpus).count() == 0


def test_pipeline_personal_data_goes(spark, corpus):
    docs = read(spark, corpus)
    got = corpus_pipeline.personal_data(spark, docs, corpus)
    assert got.columns == docs.columns and got.count() == docs.count()
    by = {r.doc_id: r for r in got.collect()}
    assert "jo.doe@x.org" not in by[2006].text and "555-2186" not in by[2006].text and by[2006].n_chars == len(by[2006].text)
    assert by[0].text == prose(0, 60) and by[0].row_key == 1 and by[0].times == 4
    assert corpus_pipeline.personal_data(spark, docs.limit(0), corpus).count() == 0


def test_pipeline_mixture_and_packing(spark, corpus):
    docs = read(spark, corpus)
    mixed = corpus_pipeline.mixture(spark, docs, corpus)
    assert mixed.columns == docs.columns
    times = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert max(n for i, n in times.items() if i is not None) <= 3
    packed = corpus_pipeline.packing(spark, docs, corpus)
    assert packed.agg(F.count_distinct("doc_id")).first()[0] == docs.where("doc_id IS NOT NULL").count()
    assert corpus_pipeline.mixture(spark, docs.limit(0), corpus).count() == 0 and corpus_pipeline.packing(spark, docs.limit(0), corpus).count() == 0


def test_pipeline_as_a_whole(spark, corpus):
    """run() equals its stages one after another, and no row of it comes from what a stage took out."""
    got = corpus_pipeline.run(spark, corpus)
    ids = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    assert ids and not ids & {2000, 2001, 2002} and not any(i is not None and 1000 <= i < 1030 for i in ids)
    assert len(ids & {1, 2003, 2004}) <= 1
    fill = got.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert fill.where("n > 2048").count() == 0


def test_marginals_with_loops_are_near_enumeration():
    """Repeats and neighbours close circles; message passing comes near the sums over all labellings and picks the same labels."""
    import itertools

    from tessera.llm import pii

    model = pii.train(["mail jo.doe7@x.org or +1 (456) 555-2186, 10.0.0.1 card 4539578763621486"] * 20)
    text = "call 14565552186 or name7, again 14565552186, name7 and +1 (456) 555-2186 then 14565552186"
    found = pii.mentions(text, pii.base_spans(text))
    edges = pii.links(found)
    assert 5 <= len(found) <= 8 and len(edges) > len(found) - 1, (found, edges)  # more links than a tree has
    unary = np.array([m.features for m in found]) @ model.node.T
    sums = np.zeros((len(found), 5))
    for labels in itertools.product(range(5), repeat=len(found)):
        if all(m.label in (-1, k) for m, k in zip(found, labels)):
            open_ = sum(unary[i, k] for i, k in enumerate(labels) if found[i].label < 0)
            sums[range(len(found)), labels] += np.exp(open_ + sum(model.pair[t, labels[i], labels[j]] for i, j, t in edges))
    exact, got = sums / sums.sum(1, keepdims=True), pii.marginals(found, model)
    assert (got.argmax(1) == exact.argmax(1)).all() and np.abs(got - exact).max() < 0.15
