"""The ten operators on small tables with nulls, ties, repeats, empty and odd rows, against brute force."""

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import graph, media, mixing, neighbours, packing, pii, quality, sharding, similarity, spans, textgrams, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, rid long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    out = [WORDS[i] + str(rng.integers(30)) for i in rng.integers(0, len(WORDS), n)]
    return " ".join(w + ("." if k % 7 == 6 else "") for k, w in enumerate(out))


def rows():
    base = [(i, prose(i, 40 + i % 9), "en", f"s{i % 4}", 1, 0, 0) for i in range(40)]
    near = [(100 + i, base[0][1] + f" extra{i}", "en", "s0", 1, 0, 0) for i in range(3)]
    copies = [(200 + i, base[1][1], "fr", "hot", 1, 0, 0) for i in range(12)]
    odd = [(300, None, None, None, None, None, None), (301, "", "en", "s1", 0, 0, 0), (302, " \n ", "en", None, 0, 0, 0), (None, "null id here.", "en", "s1", 0, 0, 0), (303, "One two", "en", "s1", 0, 0, 0), (304, "one TWO", "en", "s1", 0, 0, 0), (304, "one TWO", "en", "s1", 0, 0, 0), (305, "y" * 5000 + " " + prose(9, 3000), "xx", "long", 0, 0, 0)]
    return base + near + copies + odd


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(rows(), DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_mix(docs, none):
    got = mixing.mix_sources(docs, block=8).documents.collect()
    assert len(got) == len(rows()) and not mixing.mix_sources(none).documents.collect()
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source_size, [r.target, 0])[1] += r.taken
    assert all(abs(t - taken) <= 16 for t, taken in by.values())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs, block=8).documents.collect()))


def test_mixture_delivers_each_sources_words(spark, tmp_path):
    data = [(i % 700 if i % 9 else None, "w " * (40 + 997 * i % 2600), "en", "abc"[(i % 50 > 18) + (i % 50 > 36)]) for i in range(900)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/d")
    table = spark.read.parquet(f"{tmp_path}/d")
    count = lambda d: {r.source: r.n for r in d.groupBy("source").agg(F.sum(F.length("text") / 2).alias("n")).collect()}
    size, got = count(table), count(corpus_pipeline.mixture(spark, table, ""))
    target = {r.source: r.target for r in mixing.source_targets(table.select("source", (F.length("text") / 2).cast("long").alias("size"))).collect()}
    assert min(target[s] / size[s] for s in size) < 0.8
    assert all(abs(got[s] - target[s]) <= 0.03 * target[s] + 1000 for s in size), (size, target, got)


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        x = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3).cast("long")).alias("x"))
        assert sorted(r.x for r in x.collect()) == list(range(n))


def test_shards(docs, none):
    got = sharding.shard_by_links(docs, shards=5).collect()
    assert len(got) == len(rows()) and not sharding.shard_by_links(none).collect()
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    texts = {r[0]: r[1] for r in rows()}
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r.size == len((texts[r.doc_id] or "").encode()) + 16 for r in got)
    assert len({r.shard for r in got if r.doc_id in (1, *range(200, 212))}) <= 2


def test_shards_settle(spark):
    """No member is left that the rule would move, in a plain recount; links are cut only in groups too large for a shard."""
    sizes = [200, *[9] * 12, *[3] * 20, *[2] * 30]
    texts = [f"group {g}" for g, n in enumerate(sizes) for _ in range(n)] + [f"alone {i}" for i in range(200)]
    got = sharding.shard_by_links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=10).collect()
    members, loose = {}, {}
    for r in got:
        text = texts[r.doc_id]
        if text.startswith("alone"):
            loose[r.shard] = loose.get(r.shard, 0) + 1
        else:
            here = members.setdefault(text, {})
            here[r.shard] = here.get(r.shard, 0) + 1
    for text, here in members.items():
        if sum(here.values()) <= 0.75 * len(texts) / 10:
            best = max((s for s in here if loose.get(s)), key=here.get, default=None)
            assert best is None or all(n > here[best] for s, n in here.items() if s != best), (text, here)
    cut = [t for t, here in members.items() if len(here) > 1]
    assert cut[0] == "group 0" and len(cut) <= 3, cut
    assert {texts[r.doc_id] for r in got if r.cut} == set(cut)


def brute_components(table, n, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in table:
        w = re.findall("[^\x20\x09-\x0d]+", (r[1] or "").translate(low))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    group = list(range(len(table)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sets, group


def test_jaccard(docs, none):
    table = rows()
    sets, group = brute_components(table, 4, 85)
    low = {}
    for r, g in zip(table, group):
        low[g] = min([x for x in (low.get(g), r[0]) if x is not None], default=None)
    want = sorted((str(r[0]), len(s), str(low[g])) for r, s, g in zip(table, sets, group))
    got = similarity.jaccard_components(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    assert not similarity.jaccard_components(none).collect()


def test_unlike_sets_do_not_make_one_cluster(spark, monkeypatch):
    # a line that all have, among a few words of their own: keys of the line alone are everyone's
    rng = np.random.default_rng(7)
    line = " ".join(f"line{k}" for k in range(30))
    texts = [" ".join(f"w{rng.integers(10**6)}" for _ in range(16)) + "\n" + line for _ in range(400)]
    texts += [t + " more" for t in texts[:5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = sorted(map(tuple, similarity.jaccard_components(docs, words=5, percent=80).collect()))
    assert {r[:1] + r[2:] for r in whole if r[3]} == {(k, k % 400, 1) for k in [*range(5), *range(400, 405)]}
    monkeypatch.setattr(similarity, "BLOCK_SHINGLES", 1000)
    signed = similarity.stage(similarity.signatures(docs.withColumn("hash", F.xxhash64("text")), 5, 80), "signatures", "kind")
    assert 10 <= similarity._clusters(signed, 80).count() < 100
    assert sorted(map(tuple, similarity.jaccard_components(docs, words=5, percent=80).collect())) == whole


@pytest.mark.parametrize("compared", [1 << 15, 20])
def test_near_pairs_lead_to_all_that_may_be_similar(compared, monkeypatch):
    monkeypatch.setattr(similarity, "COMPARED", compared)
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(120):
        grams = np.unique(rng.integers(0, 2**63, rng.integers(1, 90), dtype=np.uint64))
        for _ in range(rng.integers(1, 4)):
            sets.append(np.unique(np.where(rng.random(len(grams)) < 0.04, rng.integers(0, 2**63, len(grams), dtype=np.uint64), grams)))
    size, bits = np.array([len(s) for s in sets]), np.array([np.frombuffer(similarity.sketch(s), np.uint64) for s in sets])
    rows, met = [], []
    for key, m in enumerate([1, 2, 2, 3, 5, 16, 17, 18, 40, len(sets)]):
        rows += sorted(rng.choice(len(sets), m, replace=False).tolist())
        met += [key] * m
    rows, met = np.array(rows), np.array(met)
    pairs = similarity.near_pairs(met, rows, size[rows], bits[rows], 80)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs.T.tolist():
        root[find(a)] = find(b)
    found = 0
    for key in range(10):
        own = rows[met == key].tolist()
        for i, a in enumerate(own):
            for b in own[:i]:
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    found += 1
                    assert find(a) == find(b)
    assert found > 20
    if compared > 20:
        assert len({find(x) for x in range(len(sets))}) > 60


def test_jaccard_in_blocks(docs, monkeypatch):
    whole = sorted(map(str, similarity.jaccard_components(docs).collect()))
    monkeypatch.setattr(similarity, "BLOCK_SHINGLES", 60)
    assert sorted(map(str, similarity.jaccard_components(docs).collect())) == whole


def test_divide_skip_is_exact():
    rng = np.random.default_rng(1)
    sets = sorted((np.unique(rng.choice(60, rng.integers(1, 50))).astype(np.uint64) for _ in range(80)), key=len)
    links, root = similarity.divide_skip(sets, np.zeros(len(sets), int), 60)
    want = [sum(100 * len(np.intersect1d(a, b)) >= 60 * len(np.union1d(a, b)) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    assert links.tolist() == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


def test_warc(spark, tmp_path):
    data = [(1, "http://a", "x"), (2, "http://b", "x"), (3, None, None), (4, "u\r\nv", ""), (5, "c", "é" * 9), (5, "c", "é" * 9)]
    spark.createDataFrame(data, "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    archive = warc.write_archive(pages)
    import base64

    b32 = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.verified_pages(archive).collect())
    assert got == [(1, 1, b32("x"), "revisit", 2), (2, 1, b32("x"), "response", 0), (3, 0, b32(""), "revisit", 4), (4, 0, b32(""), "response", 0), (5, 18, b32("é" * 9), "response", 0), (5, 18, b32("é" * 9), "revisit", 5)]
    records = [bytes(r.record) for r in warc.read_records(archive).collect()]
    assert len(records) == 6 and sum(r.endswith("é".encode() * 9 + b"\r\n\r\n") for r in records) == 1
    assert not warc.verified_pages(warc.write_archive(pages.limit(0))).collect()


def test_packing(docs, none):
    got = packing.pack_pieces(packing.tokenize_pieces(docs, most=64), most=64, part_rows=20).collect()
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for r in rows():
        ids = [*coder.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want.append((str(r[0]), k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    bound = packing.lower_bound(np.array([r.length for r in got]), 64)
    assert bound <= len(bins) <= bound * 1.05 + 2
    assert not packing.pack_documents(none).collect()


@pytest.mark.parametrize("case", ["null ids", "lasting gaps"])
def test_packing_keeps_its_partitions_small(spark, case):
    """A third of null ids lies in no large partition, and gaps that last gather nothing."""
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 2049, 4096) if case == "null ids" else rng.integers(300, 800, 4096)
    rows = [(None if i % 3 == 0 else i, 0, 0, int(n), i) for i, n in enumerate(lengths)]
    got = packing.pack_pieces(spark.createDataFrame(rows, packing.PIECE).repartition(7), part_rows=64).toPandas()
    assert sorted(got["ids_crc32"]) == list(range(4096))
    used, size = got["sequence_id"].nunique(), got.groupby(got["sequence_id"] // (1 << 24)).size()
    assert size.max() <= 3 * 64
    assert (got.groupby("sequence_id")["length"].sum() <= 2048).all()
    parts = got.groupby(got["sequence_id"] // (1 << 24)).agg(bins=("bins", "first"), bound=("bound", "first"), n=("sequence_id", "nunique"))
    assert (parts["bins"] == parts["n"]).all() and (parts["bound"] <= parts["bins"]).all()
    alone = sum(packing.best_fit_decreasing(lengths[i : i + 64], 2048)[1] for i in range(0, 4096, 64))
    assert packing.lower_bound(lengths, 2048) <= used <= alone


def test_words_have_the_ids_of_their_text():
    coder = packing.WordCoder(packing.tokenizer_path())
    rng = np.random.default_rng(8)
    signs = list("aAbZéÉñßİ'’.,!?-_#19 \n\t\u0301中ﬁ<|>sS$& \x85\x1c")
    odd = ["THE <|endoftext|> <|EndOfText|>x.y <|startoftext|>", "it's don't 'tis x'y'z a.'s", "Σας ΌΣΟΣ. K Ω", "a" * 300 + ".", "", None]
    odd += ["".join(rng.choice(signs, rng.integers(0, 60))) for _ in range(3000)]
    flat, at = coder.encode(pa.array(odd))
    for k, text in enumerate(odd):
        assert flat[at[k] : at[k + 1]].tolist() == coder.tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_best_fit_and_bound():
    rng = np.random.default_rng(2)
    for _ in range(50):
        x = rng.integers(1, 101, rng.integers(1, 60))
        bins, n = packing.best_fit_decreasing(x, 100)
        assert np.bincount(bins, x, n).max() <= 100 and packing.lower_bound(x, 100) <= n


def test_personal_data(spark, docs, none):
    def naive(t):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        digits = lambda s: re.sub("[^0-9]", "", s)
        out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and pii._luhn(digits(m[0]))]
        out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
        return sorted(out)

    rng = np.random.default_rng(3)
    for _ in range(5000):
        t = "".join(rng.choice(list("a.@+-0 12(3)é4%_b"), rng.integers(0, 40)))
        assert [tuple(s) for s in pii.base_spans(t)] == naive(t)
    model = pii.train(["mail jo.doe7@x.org or +1 (456) 555-2186, 10.0.0.1 card 4539578763621486"] * 20)
    t = "call +1 (456) 555-2186 now; 1 456 555 2186 again; order 7654321; jo.doe7@x.org, then jo.doe7 wrote"
    more = {t[s.start : s.end] for s in pii.all_spans(t, pii.base_spans(t), model)} - {t[s.start : s.end] for s in pii.base_spans(t)}
    assert more == {"1 456 555 2186", "jo.doe7"}
    got = pii.find_personal_data(docs, model).collect()
    assert len(got) == len(rows()) and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got if not r.spans)
    one = spark.createDataFrame([(1, t)], "doc_id long, text string")
    assert pii.redact(one, model).first().text.startswith("call [PHONE] now; [PHONE] again; order 7654321; [EMAIL], then [EMAIL]")
    assert not pii.find_personal_data(none, pii.train_model(none)).collect()


def test_marginals_equal_enumeration():
    import itertools

    model = pii.train(["mail jo.doe7@x.org or +1 (456) 555-2186, 10.0.0.1 card 4539578763621486"] * 20)
    text = "call 14565552186 or name7, or 14565550000, mail a.b@c.de or 4539578763621486"
    found = pii.mentions(text, pii.base_spans(text))
    edges = pii.links(found)
    assert 3 <= len(found) <= 6 and len(edges) == len(found) - 1, found  # a chain
    unary = np.array([m.features for m in found]) @ model.node.T
    sums = np.zeros((len(found), 5))
    for labels in itertools.product(range(5), repeat=len(found)):
        if all(m.label in (-1, k) for m, k in zip(found, labels)):
            open_ = sum(unary[i, k] for i, k in enumerate(labels) if found[i].label < 0)
            sums[range(len(found)), labels] += np.exp(open_ + sum(model.pair[t, labels[i], labels[j]] for i, j, t in edges))
    assert np.abs(pii.marginals(found, model) - sums / sums.sum(1, keepdims=True)).max() < 1e-6


def test_repeats_without_a_cue_are_found_and_decoys_left():
    rng = np.random.default_rng(11)
    filler = lambda: " ".join(rng.choice(WORDS, 12))
    phone = lambda: f"1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"
    train = [f"{filler()} +{phone()} {filler()} ab.c{i}@mail{i % 9}.org {filler()} 4539578763621486 {filler()} {rng.integers(10**15, 10**16)}" for i in range(200)]
    model = pii.train(train)
    hit = wrong = 0
    for i in range(100):
        p, name, decoy = phone(), f"jo.roe{i}", str(rng.integers(10**6, 10**7))
        text = f"{filler()} +{p} {filler()} {name}@m.org {filler()} {p} {filler()} {name} {filler()} {decoy}"
        base = pii.base_spans(text)
        more = {text[s.start : s.end] for s in pii.all_spans(text, base, model)} - {text[s.start : s.end] for s in base}
        hit += len(more & {p, name})
        wrong += len(more - {p, name})
    assert hit >= 180 and wrong <= 5, (hit, wrong)


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 16)).astype(np.float32)
    x[7] = x[5]
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(400, None), (420, [0.0] * 16), (440, [float("nan")] * 16), (460, [1.0]), (None, [1.0] * 16)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = neighbours.nearest_neighbours(table, block=16, k=5).collect()
    y = x.astype(float)
    for q in range(0, 300, 20):
        s = np.array([sum(np.float64(y[q, k]) * y[i, k] for k in range(16)) if i != q else -np.inf for i in range(300)])
        order = np.lexsort((np.arange(300), -s))[:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[1] for m in mine] == order.tolist() and [m[2] for m in mine] == s[order].tolist()
    assert len(got) == 75
    assert not neighbours.nearest_neighbours(table.limit(0)).collect()


def test_hilbert_neighbours_touch():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    keys = neighbours.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_span_dedup(spark, none):
    passage = "Here is a shared passage of some words. It goes on for a while longer. And then it ends after this sentence. Done now, truly."
    data = [(1, f"First start.\n{passage} Own tail one."), (2, f"Other head here. {passage} Own tail two."), (3, passage.upper()), (4, "Of. The. As."), (5, "Of. The. As."), (6, None), (7, ""), (None, passage)]
    table = spark.createDataFrame([(*r, "x", 1) for r in data], "doc_id long, text string, pos string, row_key int")
    got = {r.doc_id: r for r in spans.dedup_spans(table).collect()}
    assert got[1].n_removed == 0 and got[1].text == data[0][1]
    assert got[2].text == "Other head here. Own tail two." and got[3].text == "" and got[None].text == ""
    assert got[5].n_removed == 0 and got[6].text is None and got[7].text == ""
    assert not spans.dedup_spans(none).collect()


def pieces(text):
    """Words of the pieces of a text, from its definition."""
    out, new = [], True
    for line in text.split("\n"):
        for w in line.split():
            (out.append([w]) if new else out[-1].append(w))
            h = textgrams.word_hashes(pa.array([w]))
            new = bool(re.search(r"[.!?][\"')\]]?$", w)) or int(textgrams.mixed(next(h)[2])[0]) % spans.CUT == 0
        new = True
    return [p for p in out if p]


def test_span_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(12)
    shared = [prose(80 + k, 60).replace(".", "" if k % 2 else ".") for k in range(4)]
    data = [(int(i), " ".join([prose(200 + i, int(rng.integers(0, 40))), shared[i % 4], prose(300 + i, 9), *([shared[0]] if i % 5 == 0 else [])])) for i in rng.permutation(24)]
    data += [(3, data[0][1]), (None, shared[1]), (50, "word!! " * 90), (51, "x " * 30_000)]
    parts = [pieces(t) for _, t in data]
    seen, gone = {}, [set() for _ in data]
    for k in sorted(range(len(data)), key=lambda k: (data[k][0] is None, data[k][0] or 0, k)):
        runs = []
        for i in range(len(parts[k])):
            for j in range(i + 1, len(parts[k]) + 1):
                n = [sum(map(len, parts[k][a:b])) for a, b in ((i, j), (i, j - 1), (i + 1, j))]
                if n[0] >= 24 and min(n[1:]) < 24:
                    runs.append((i, j))
                if min(n[1:]) >= 24:
                    break
        for i, j in runs:
            words = tuple(w.lower() for p in parts[k][i:j] for w in p)
            if seen.setdefault(words, (k, i)) != (k, i):
                gone[k] |= set(range(i, j))
    want = sorted((str(d), " ".join(w for i, p in enumerate(parts[k]) if i not in gone[k] for w in p)) for k, (d, _) in enumerate(data))
    table = spark.createDataFrame(data, "doc_id long, text string").coalesce(1)
    assert sorted((str(r.doc_id), " ".join(r.text.split())) for r in spans.dedup_spans(table).collect()) == want


@pytest.mark.parametrize("length", [2, 8, 15, 30, None])
def test_span_dedup_finds_passages(spark, length):
    """Passages of 60 words in two hosts, with sentences of many lengths."""
    data = []
    for k in range(40):
        words = prose(1000 + k, 60).replace(".", "").split()
        passage = " ".join(w + ("." if length and i % length == length - 1 else "") for i, w in enumerate(words))
        data += [(2 * k + j, f"{prose(2000 + 2 * k + j, 30)[:-3]} {passage} {prose(3000 + 2 * k + j, 30)}") for j in (0, 1)]
    got = {r.doc_id: r.n_removed for r in spans.dedup_spans(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert sum(got[2 * k + 1] > 0 for k in range(40)) >= 39 and not any(got[2 * k] for k in range(40))


def test_media(spark, docs, none):
    got = media.media_features(media.store_payloads(docs)).collect()
    texts = rows()
    assert len(got) == len(texts)
    for r in got:
        raw = next((t[1] or "").encode() for t in texts if t[0] == r.doc_id)
        n = max(1, -(-len(raw) // 576)) * 576
        payload = raw.ljust(n, b"\xff")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes) == (len(raw), n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), n + 44)
    assert not media.media_features(media.store_payloads(none)).collect()


def test_sniffing(spark):
    import zipfile

    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IEND", b"")
    gif = b"GIF89a\1\0\1\0\x80\0\0" + bytes(6) + b",\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
    zipped = io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("a", "text")
    pdf = b"%PDF-1.4\nstartxref\n9\n%%EOF"
    bmp = b"BM" + struct.pack("<IIIIiiHH", 58, 0, 54, 40, 1, 1, 1, 24) + bytes(28)
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\2xyz\xff\xd9"
    search = media.automaton()
    for data, kind in ((png, "image/png"), (gif, "image/gif"), (zipped.getvalue(), "application/zip"), (pdf, "application/pdf"), (bmp, "image/bmp"), (jpeg, "image/jpeg")):
        assert media.sniff(b"junk BM RIFF" + data + b"tail", search) == [media.Found(kind, 12, 12 + len(data))]
        assert not media.sniff(data[:-3], search)
    table = spark.createDataFrame([(1, bytearray(png + gif), "text/plain"), (2, None, "x/y"), (3, bytearray(b"GIF89a nothing"), "image/gif")], "k int, media binary, declared string")
    got = {r.k: (r.media_type, [c.kind for c in r.carved]) for r in media.sniff_media(table).collect()}
    assert got == {1: ("image/png", ["image/gif"]), 2: ("x/y", []), 3: ("image/gif", [])}


def test_quality(spark, none):
    good = [(i, prose(i, 80), "en") for i in range(120)]
    junk = [(500 + i, " ".join(w[::-1].upper() + "$$" for w in prose(i, 60).split()), "en") for i in range(5)] + [(600, None, "en"), (601, prose(7, 50), None)]
    table = spark.createDataFrame(good + junk, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(80)] + [(500, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.keep for r in quality.classify(table, labels).collect()}
    assert sum(got[i] for i in range(120)) >= 115 and not any(got[500 + i] for i in range(5)) and got[600] is False and got[601]
    assert not quality.classify(none, labels).collect()
    assert quality.classify(table, labels.limit(0)).where("keep").count() == 126


def test_quality_rejects_junk_of_ordinary_words(spark):
    def order(i):
        """Sentences of fixed phrases; junk has the same words, out of order."""
        rng = np.random.default_rng(i)
        return [w for k in rng.integers(0, 20, 30) for w in prose(1000 + k, 4).split()]

    good = [(i, " ".join(order(i)), "en") for i in range(300)]
    junk = [(1000 + i, " ".join(np.random.default_rng(i).permutation(order(i))), "en") for i in range(60)]
    odd = [(2000 + i, " ".join(f"{w}{i}q" for w in prose(i, 60).split()), "en") for i in range(40)]
    table = spark.createDataFrame(good + junk + odd, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(200)] + [(1000 + i, 0) for i in range(30)] + [(2000 + i, 1) for i in range(40)], "doc_id long, quality int")
    got = {r.doc_id: r.keep for r in quality.classify(table, labels).collect()}
    assert sum(not got[1000 + i] for i in range(30, 60)) >= 28 and sum(got[i] for i in range(200, 300)) >= 97


def perplexities(texts, scored):
    """Log perplexity under an interpolated modified Kneser-Ney model, from plain dictionaries."""
    from collections import Counter

    def grams(text):
        w = text.lower().split()
        return list(zip(["", "", *w], ["", *w], w))

    c3 = Counter(g for t in texts for g in grams(t))
    c2 = Counter(g[1:] for g in c3)
    c1 = Counter(g[1:] for g in c2)
    d1, d2, d3 = (quality._discounts(*[list(c.values()).count(k) for k in (1, 2, 3, 4)]) for c in (c1, c2, c3))

    def less(n, d):
        return n - d[min(n, 3) - 1] if n else 0

    def level(counts, d):
        total, left = Counter(), Counter()
        for g, n in counts.items():
            total[g[:-1]] += n
            left[g[:-1]] += d[min(n, 3) - 1]
        return total, left

    (t1, l1), (t2, l2), (t3, l3) = level(c1, d1), level(c2, d2), level(c3, d3)

    def p(a, b, c):
        low = less(c1[c,], d1) / t1[()] + l1[()] / t1[()] / (len(c1) + 1)
        low = (less(c2[b, c], d2) + l2[b,] * low) / t2[b,] if t2[b,] else low
        return (less(c3[a, b, c], d3) + l3[a, b] * low) / t3[a, b] if t3[a, b] else low

    words = [w for (w,) in c1] + ["no such word"]
    for a, b in (("", ""), ("", texts[0].split()[0].lower()), tuple(texts[0].lower().split()[:2])):
        assert abs(sum(p(a, b, c) for c in words) - 1) < 1e-9
    return [-np.mean([np.log(p(*g)) for g in grams(t)]) if t and t.split() else None for t in scored]


@pytest.mark.parametrize("gather, block", [(1 << 20, 1 << 21), (50, 100)])
def test_quality_scores_equal_brute_force(spark, tmp_path, monkeypatch, gather, block):
    monkeypatch.setattr(quality, "GATHER", gather)
    monkeypatch.setattr(quality, "BLOCK", block)
    texts = [prose(i % 5, 60 + i) for i in range(9)]
    scored = [*texts, prose(77, 300), "never seen words", None, "", prose(3, 50), prose(3, 50), prose(8, 30_000)]
    model = quality.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    spark.createDataFrame([(k, "en", t, k) for k, t in enumerate(scored)], "doc_id long, lang string, text string, row_key long").write.parquet(f"{tmp_path}/d")
    got = {r.doc_id: r.log_perplexity for r in quality.score(spark.read.parquet(f"{tmp_path}/d"), model).collect()}
    assert len(got) == len(scored)
    for k, want in enumerate(perplexities(texts, scored)):
        assert got[k] is None if want is None else abs(got[k] - want) < 1e-9


def test_shingles_do_not_depend_on_segments():
    texts = pa.array([prose(i, 30) for i in range(20)] + [None, "", "a b"])
    whole = [s.tolist() for s in textgrams.shingle_sets(texts, 4)]
    old, textgrams.SEGMENT = textgrams.SEGMENT, 100
    try:
        parts = [w for i, j, w, d in textgrams.word_hashes(texts, 100)]
        assert np.concatenate(parts).tolist() == np.concatenate([w for _, _, w, _ in textgrams.word_hashes(texts)]).tolist()
    finally:
        textgrams.SEGMENT = old
    assert len(whole) == 23 and whole[-2] == whole[-3] == []


def test_packed_columns_take_the_bytes_they_need():
    for cols in ([[]], [[3]], [[5, 5, 2**63, 2**64 - 1]], [[7, 2, 300]], [[0, 0, 0], [1, 256, 2**40]], [[], []]):
        assert textgrams.unpacked(textgrams.packed(*(np.array(c, np.uint64) for c in cols))).tolist() == cols
    told = textgrams.packed(np.arange(1000), np.ones(1000))
    assert len(zstandard.decompress(told[1 + told[0] :])) == 2000  # 16000 before


def test_workers_keep_small_tables_of_powers(monkeypatch):
    monkeypatch.setattr(textgrams, "_powers", (np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
    texts = pa.array([prose(i, 400) for i in range(2000)])
    assert sum(map(len, texts.to_pylist())) > 1 << 21
    words = np.concatenate([w for _, _, w, _ in textgrams.word_hashes(texts)])
    assert sum(p.nbytes for p in textgrams._powers) <= 1 << 23  # 32 MB before
    assert words.tolist() == np.concatenate([w for _, _, w, _ in textgrams.word_hashes(texts, 1 << 22)]).tolist()
