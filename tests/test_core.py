import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import symbols as S
from tessera.functions import text as T
from tessera.functions.vectors import cosine, is_valid
from tessera.operators import graph, lifecycle, resolve, retrieval, snapshot
from tessera.operators.index import Index
from tessera.sources import files
from tessera.streaming import hints


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<double>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, expected",
    [
        ("parseHTTPServer2Go", ["parsehttpserver2go", "parse", "http", "server", "go"]),
        ("the order for a user", ["order", "user"]),
        ("submit_order submit", ["submit", "order", "submit"]),
        ("", []),
        ("Ünïcode", ["ünïcode"]),
    ],
)
def test_tokens(spark, text, expected):
    assert one(spark, T.tokens(F.col("t")), t=text) == expected


def test_paths(spark):
    norm = lambda p: one(spark, T.normal_path(F.col("p")), p=p)
    assert norm("a/./b/../c") == "a/c"
    assert norm("a\\b") == "a/b"
    assert norm("../a") is None and norm("/a") is None and norm(".") is None
    assert one(spark, T.language(F.col("p")), p="x/Y.TSX") == "typescriptreact"
    assert one(spark, T.language(F.col("p")), p="x/y.txt") is None
    assert one(spark, T.module_key(F.col("p")), p="internal/store/a.go") == "internal/store"
    assert one(spark, T.module_key(F.col("p")), p="a.go") == "root"


def test_cosine_and_validity(spark):
    assert one(spark, cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(math.sqrt(0.5))
    assert one(spark, cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 1.0]) == 0
    assert one(spark, cosine(F.col("a"), F.col("b")), a=[1.0], b=[1.0, 1.0]) == 0
    for v, ok in (([1.0], True), ([0.0], False), ([float("nan")], False), ([float("inf")], False)):
        assert one(spark, is_valid(F.col("a")), a=v) is ok


def test_bm25_prefers_exact(spark, tmp_path):
    docs = spark.createDataFrame([(1, "SubmitOrder", "saves an order"), (2, "Other", "order order"), (3, "None", "nothing")], "id int, name string, body string")
    index = Index(spark, tmp_path.as_uri(), {"name": 4, "body": 1}).refresh(docs)
    ranked = [r.id for r in retrieval.top(index.bm25(["submit", "order"]), 5).collect()]
    assert ranked == [1, 2]


def test_absent_dense_hit_beats_negative(spark):
    lexical = spark.createDataFrame([(1, 1.0), (2, 1.0)], "id int, score double")
    dense = spark.createDataFrame([(2, -0.5)], "id int, similarity double")
    got = {r.id: r.score for r in retrieval.fused(lexical, dense).collect()}
    assert got[1] == pytest.approx(0.84) and got[2] == pytest.approx(0.76)


def test_resolution(spark):
    symbols = spark.createDataFrame([("s1", "save", "a/x.go", False), ("s2", "save", "b/y.go", False), ("s3", "load", "b/z.go", False)], "id string, name string, path string, is_file boolean")
    edges = spark.createDataFrame([("save", "b/y.go", 0.5), ("save", "b/q.go", 0.8), ("load", "c.go", 0.1), ("gone", "c.go", 0.3)], "name string, path string, confidence double")
    got = {(r.name, r.path): (r.target, r.confidence) for r in resolve.resolve_names(edges, symbols).collect()}
    assert got == {("save", "b/y.go"): ("s2", 0.7), ("save", "b/q.go"): ("s2", 0.8), ("load", "c.go"): ("s3", 0.95), ("gone", "c.go"): (None, 0.3)}
    paths = spark.createDataFrame([("f1", "src/foo/bar.ts"), ("f2", "lib/foo/bar.ts"), ("f3", "lib/foobar.ts")], "id string, path string")
    wanted = spark.createDataFrame([("./foo/bar",), ("bar",), ("oobar",), ("./",)], "target string")
    got = {r.target: r.file_id for r in resolve.resolve_imports(wanted, paths).collect()}
    assert got == {"./foo/bar": "f2", "bar": "f2", "oobar": None}


def test_neighbourhood_stops_at_cap(spark):
    edges = spark.createDataFrame([(i, "a", f"b{i}", "calls") for i in range(9)] + [(99, "b0", "c", "calls"), (100, "z", "y", "calls")], "idx int, src string, dst string, kind string")
    got = graph.neighbourhood(edges, ["a"], depth=2, most=5)
    assert sorted(r.node for r in got.collect()) == ["a", "b0", "b1", "b2", "b3"]
    assert graph.induced(edges, got).count() == 4
    assert graph.neighbourhood(edges, ["a"], 2, 40).where("level = 2").collect()[0].node == "c"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.booleans()), min_size=1, max_size=12))
def test_budget_fold(spark, items):
    rows = spark.createDataFrame([(1, i, s, t) for i, (s, t) in enumerate(items)], "req int, rank int, size int, is_target boolean")
    got = {r.rank: r.accepted for r in graph.within_budget(rows, "req", 60, 3).collect()}
    used = n = 0
    for i, (size, target) in enumerate(items):
        ok = target or (n < 3 and used + size <= 60)
        assert got[i] is ok
        used, n = used + size * ok, n + ok


def test_changes_and_root(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "path string, content_hash string")
    b = spark.createDataFrame([("w", "0"), ("y", "9"), ("x", "1")], "path string, content_hash string")
    assert {tuple(r) for r in snapshot.changes(a, b).collect()} == {("w", "added"), ("y", "changed"), ("z", "removed")}
    root = lambda df: snapshot.root_digest(snapshot.bucket_digests(df, "files", F.col("path"), F.col("content_hash"))).first().root
    assert root(a) == root(a.orderBy(F.desc("path"))) != root(b)
    merged = snapshot.upserted(a, b.where("path = 'y'"), a.where("path = 'z'"))
    assert {tuple(r) for r in merged.collect()} == {("x", "1"), ("y", "9")}


def test_fact_fusion(spark):
    one = lambda k, i, c, **more: {"k": k, "seq": i, "fact_id": f"f{i:02}", "source": "ast", "method": "", "path": "p", "line": 1, "col": 0, "confidence": c, "version_known": True, "document_version": 1, "conflict": False, **more}
    rows = [one(1, i, 0.5 + i / 100) for i in range(40)]  # the last eight don't count
    rows += [one(2, 1, 0.9, version_known=False), one(2, 2, 0.95, fact_id="f01", version_known=False), one(3, 1, 0.8, conflict=True), one(4, 1, 0.9, version_known=False, document_version=0)]
    facts = spark.createDataFrame(rows)
    got = {r.k: (r.support, round(r.ranking_confidence, 3), r.truncated) for r in snapshot.fused_facts(facts, ["k"]).collect()}
    assert got == {1: (32, 0.81, True), 2: (1, 0.6, False), 3: (1, 0.4, False), 4: (1, 0.9, False)}


def test_calls_by_name_join_resolved_ones(spark):
    rows = [(1, 7, "Save", 10), (1, None, "SAVE", 11), (1, None, "load", 12), (2, None, "save", 13)]
    got = snapshot.correlated(spark.createDataFrame(rows, "subject int, object int, name string, evidence int")).collect()
    assert {r.evidence: (r.object, r.external) for r in got} == {10: (7, None), 11: (7, None), 12: (None, "load"), 13: (None, "save")}


def hint(ms, sequence, path="a/x.go", operations=2, kind="unknown", reason="", root="r"):
    from datetime import datetime, timedelta

    return (root, datetime(2024, 1, 1) + timedelta(milliseconds=ms), sequence, path, operations, kind, reason)


def requested(spark, rows):
    table = spark.createDataFrame(rows, "root string, ts timestamp, sequence long, path string, operations int, kind string, reason string")
    return hints.coalesced_paths(hints.requests(hints.meaningful(table), 0.25, 1.0))


def test_requests_end_after_quiet_or_the_longest_delay(spark):
    rows = [hint(0, 7), hint(200, 8), hint(450, 9), *[hint(200 * i, 20 + i, root="busy") for i in range(8)], hint(0, 1, operations=hints.CHMOD, root="still")]
    got = sorted((r.root, r.request, r.sequence) for r in requested(spark, rows).collect())
    assert got == [("busy", 1, 20), ("busy", 2, 25), ("r", 1, 7), ("r", 2, 9)]


def test_scopes(spark):
    cases = {
        "paths": [hint(0, 1, "a/b/x.go"), hint(0, 2, "a/c/y.go", kind="file")],
        "subtree": [hint(0, 1, "a/b/x.go"), hint(0, 2, "a/c/d", kind="directory")],
        "nested": [hint(0, 1, "a/b/.gitignore"), hint(0, 2, "a/b/c/x.go")],
        "apart": [hint(0, 1, "a/b", operations=hints.RENAME), hint(0, 2, "c/d.go")],
        "ignore": [hint(0, 1, ".gitignore")],
        "rescan": [hint(0, 1, "a/x.go", operations=hints.RESCAN)],
    }
    rows = [(root, *r[1:]) for root, own in cases.items() for r in own]
    got = {r.root: (r.mode, r.common, r.paths) for r in hints.scopes(requested(spark, rows)).collect()}
    assert got == {"paths": ("paths", "", 2), "subtree": ("subtree", "a", 2), "nested": ("subtree", "a/b", 2), "apart": ("full", "", 2), "ignore": ("full", "", 1), "rescan": ("full", "", 1)}


def test_symbol_predicates(spark):
    rows = [("TestX", "function", "go", "a/b.go"), ("test_x", "method", "python", "tests/a.py"), ("run", "function", "go", "a/b_test.go"), ("Test", "function", "rust", "a.rs"), ("testA", "method", "swift", "X/tests/a.swift"), ("main", "import", "go", "x.go")]
    table = spark.createDataFrame(rows, "name string, kind string, language string, path string")
    n, k, g, p = (F.col(c) for c in table.columns)
    got = [tuple(r) for r in table.select(S.is_test_symbol(n, k, g, p), S.is_overview_seed(n, k), S.is_test_path(p), S.is_exported(n)).collect()]
    assert [r[0] for r in got] == [True, True, True, False, True, False]
    assert [r[1] for r in got] == [True, False, False, True, False, True]
    assert [r[2] for r in got] == [False, True, True, False, True, False] and [r[3] for r in got] == [True, False, False, True, False, False]
    files = spark.createDataFrame([(x,) for x in ("go.mod", "a/README.md", ".env", "b/.env.example", "Dockerfile.x", "c.txt")], "path string")
    assert [r[0] for r in files.select(S.project_language(F.col("path"))).collect()] == ["gomod", "markdown", None, "dotenv", "dockerfile", None]
    text = spark.createDataFrame([("a" * 60 + "\n" + "b" * 60,), ("short",), ("c" * 200,)], "t string")
    assert [len(r[0]) for r in text.select(S.preview(F.col("t"), 100)).collect()] == [61, 5, 100]


def test_external_kinds(spark):
    rows = [("calls", "len", "go", None), ("calls", "fmt.Print", "go", "fmt"), ("calls", "x.Do", "go", "example.com/x"), ("calls", "local", "go", None), ("imports", "os", "go", None), ("imports", "numpy", "python", None), ("calls", " ", "python", None)]
    table = spark.createDataFrame(rows, "kind string, to_name string, language string, imported string")
    got = [r[0] for r in table.select(S.external_kind(*[F.col(c) for c in table.columns])).collect()]
    assert got == ["builtin", "stdlib", "external", None, "stdlib", "external", None]


def test_own_writes(spark):
    rows = [(1, "a", "published", 5, 1, "x", "2024-02-01"), (2, "a", "published", 5, 2, "y", "2024-02-01"), (3, "a", "staged", 9, 3, "z", "2024-02-01"), (4, "b", "published", 1, 1, "x", "2024-01-01"), (5, "c", "published", 1, 1, "x", None)]
    made = spark.createDataFrame(rows, "id long, path string, state string, revision long, published_at long, hash string, expires_at string").withColumn("expires_at", F.to_timestamp("expires_at"))
    seen = spark.createDataFrame([("a", True, "y", "y", 5), ("a", True, "y", "y", 4), ("a", True, "x", "x", 9), ("b", True, "x", "x", 9), ("c", False, None, None, None), ("d", False, "", "", 0), ("c", True, None, "x", 2)], "path string, present boolean, content_hash string, store_hash string, store_revision long")
    got = sorted((r.path, r.mutation_id or 0, r.classification) for r in lifecycle.classified(seen, made, "2024-01-15 00:00:00").collect())
    assert got == [("a", 2, "external_change"), ("a", 2, "external_change"), ("a", 2, "self_write_confirmed"), ("b", 0, "unchanged"), ("c", 5, "external_change"), ("c", 5, "removed"), ("d", 0, "removed")]
    assert {r.state: r["count"] for r in lifecycle.unexpired(made, "2024-01-15 00:00:00").groupBy("state").count().collect()} == {"published": 3, "staged": 1, "expired": 1}


def test_heads_keep_a_version_after_a_failure(spark):
    rows = [("a", 1, "publish", "a1", "now", "p", ""), ("a", 2, "failure", "", "", "", "late"), ("b", 1, "failure", "", "", "", "first"), ("b", 2, "publish", "b2", "old", "p", ""), ("c", 1, "failure", "", "", "", "x"), ("c", 2, "publish", "c2", "now", "pp", ""), ("d", 1, "publish", "d1", "now", "", ""), ("e", 1, "publish", "e1", "now", "ppp", "")]
    events = spark.createDataFrame(rows, "key string, seq long, kind string, id string, input_snapshot string, payload string, error string")
    got = {r.key: (r.latest_revision, r.current, r.status, r.last_error) for r in lifecycle.heads(events, "now", 2).collect()}
    assert got == {"a": (1, "a1", "current", "late"), "b": (0, None, "failed", "first"), "c": (1, "c2", "current", "")}


def test_evaluation_and_surfaces(spark):
    cases = spark.createDataFrame([(1, "run", 5, 10, 11), (2, "", 0, 0, 9), (3, "x", 1, 10, 10)], "case_id long, symbol string, target long, requested long, used long")
    pack = spark.createDataFrame([(1, "e1", 5, "a/b.T::run — calls", "web/1.go", "k"), (1, "e1", 6, "x", "vendor/y.go", ""), (3, "e2", 2, "x", "a", "k")], "case_id long, id string, symbol_id long, title string, path string, kind string")
    relevant = spark.createDataFrame([(1, "run"), (1, "gone")], "case_id long, name string")
    got = {r.case_id: tuple(r)[1:] for r in lifecycle.case_metrics(cases, pack, relevant, ["vendor/**"]).collect()}
    assert got == {1: (2, True, 0.5, 1, 0.5, 0.5, 1), 2: (0, True, 1.0, 0, 0.0, 0.0, 0), 3: (1, False, 1.0, 0, 0.0, 0.0, 0)}
    page = spark.createDataFrame([(1, "# T\n  - [a](b)\r\n* c\n```\nx\n```"), (2, ""), (3, "Possibly so")], "id long, markdown string")
    scores = {r.id: (r.citation_density, r.structure, r.code_blocks, r.speculation, r.score) for r in lifecycle.surface_scores(page, {"t": "# T", "u": "# U"}, True).collect()}
    assert scores == {1: (0.5, 0.5, 1, 0, 60.0), 2: (0.0, 0.0, 0, 0, 10.0), 3: (0.0, 0.0, 0, 1, 0.0)}


def test_page_paths(spark):
    pages = spark.createDataFrame([("overview", ""), ("2-b", "overview"), ("1-a", "overview"), ("2.1-c", "2-b"), ("x", "gone"), ("y", "y"), ("z", None)], "slug string, parent string")
    assert [r.slug for r in lifecycle.page_paths(pages).orderBy("at").collect()] == ["overview", "1-a", "2-b", "2.1-c", "x", "y", "z"]
    deep = [("overview", ""), ("a", "overview"), *[(f"d{i:03}", f"d{i - 1:03}" if i else "a") for i in range(130)], ("p", "q"), ("q", "r"), ("r", "p"), ("o", "q"), ("s", "p"), ("z", "")]
    got = [r.slug for r in lifecycle.page_paths(spark.createDataFrame(deep, "slug string, parent string")).orderBy("at").collect()]
    assert got == ["overview", "a", *[f"d{i:03}" for i in range(130)], "z", "o", "p", "r", "q", "s"]


def test_changes_see_files_without_a_hash(spark):
    make = lambda rows: spark.createDataFrame(rows, "path string, content_hash string")
    got = snapshot.changes(make([("a", None), ("b", "1"), ("c", "2")]), make([("a", "3"), ("b", "1"), ("d", None)])).collect()
    assert {r.path: r.change for r in got} == {"a": "changed", "c": "removed", "d": "added"}


def test_scan_ignores_and_hashes(spark, tmp_path):
    for p in ("a/m.py", "node_modules/x.js", "b/skip.go", "note.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    got = files.scan(spark, str(tmp_path), ["!keep", "b/skip*"]).collect()
    assert [(r.path, r.language) for r in got] == [("a/m.py", "python")]


def test_stream_sessions_match_batch(spark, tmp_path):
    rows = spark.createDataFrame([("r", "2024-01-01 00:00:00", 1, hints.CREATE), ("r", "2024-01-01 00:05:00", 2, hints.RENAME), ("r", "2024-01-01 00:06:00", 3, hints.CHMOD), ("r", "2024-01-01 03:00:00", 4, hints.WRITE)], "root string, ts string, sequence long, operations long")
    rows = rows.withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    batch = hints.coalesced(hints.meaningful(rows)).orderBy("started").collect()
    assert [(r.hints, r.operations, r.min_sequence, r.max_sequence) for r in batch] == [(2, 9, 1, 2), (1, 2, 4, 4)]
    stream = hints.stream_requests(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("sessions").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    closed = spark.table("sessions").collect()
    assert [(r.hints, r.operations, r["mode"]) for r in closed] == [(2, 9, "subtree")]
