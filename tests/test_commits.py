"""Commits: versions, conflicts, faults; the kept index against one made anew."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.commits import Change, Conflict, Invalid, Store, diagnostics
from tessera.operators.index import SEGMENTS, Index
from tessera.operators.lineage import Files

TABLES = {"files": "path string, hash string", "symbols": "path string, id string, occurrence string", "vectors": "id string, vector array<double>"}


def table(spark, name, rows):
    return spark.createDataFrame(rows, TABLES[name])


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, tmp_path.as_uri(), TABLES, digits=1)


def test_upserts_replace_a_file_and_old_revisions_stay(spark, store):
    assert store.head()["revision"] == 0 and rows(store.table("files")) == []
    store.commit(Change({"files": table(spark, "files", [("a.go", "1"), ("b.go", "1"), ("c.go", "1")]), "symbols": table(spark, "symbols", [("a.go", "x", "x1"), ("a.go", "y", "y1"), ("b.go", "z", None)])}), 0)
    two = store.commit(Change({"files": table(spark, "files", [("a.go", "2")]), "symbols": table(spark, "symbols", [("a.go", "w", "w2")])}, spark.createDataFrame([("c.go",)], "path string")), 1)
    assert two["revision"] == 2
    assert rows(store.table("files")) == [("a.go", "2"), ("b.go", "1")]
    assert rows(store.table("symbols")) == [("a.go", "w", "w2"), ("b.go", "z", None)]
    assert rows(store.table("symbols", 1)) == [("a.go", "x", "x1"), ("a.go", "y", "y1"), ("b.go", "z", None)]
    # a file without symbols loses its own; a table without a path is exchanged as a whole
    store.commit(Change({"files": table(spark, "files", [("b.go", "3")])}, replaced={"vectors": table(spark, "vectors", [("w", [1.0])])}), 2)
    assert rows(store.table("symbols")) == [("a.go", "w", "w2")] and rows(store.table("vectors")) == [("w", [1.0])]
    same = store.commit(Change({"files": table(spark, "files", [("b.go", "3")])}), 3)
    assert same["revision"] == 3


def test_the_snapshot_depends_on_the_rows_alone(spark, store, tmp_path):
    store.commit(Change({"files": table(spark, "files", [("a.go", "1"), ("b.go", "1")])}), 0)
    one = store.commit(Change({"files": table(spark, "files", [("a.go", "2")])}, spark.createDataFrame([("b.go",)], "path string")), 1)
    other = Store(spark, f"{tmp_path.as_uri()}/other", TABLES, digits=1).commit(Change({"files": table(spark, "files", [("a.go", "2")])}), 0)
    assert one["snapshot"] == other["snapshot"]


def test_racing_commits_make_one_revision(spark, store):
    store.commit(Change({"files": table(spark, "files", [("a.go", "1")])}), 0)
    outcomes = []

    def race(mark):
        own = Store(spark, store.root, TABLES, digits=1)
        own.head = lambda: store.manifests.at(1)  # both have read revision 1
        try:
            own.commit(Change({"files": table(spark, "files", [(f"{mark}.go", mark)])}), 1)
            outcomes.append(mark)
        except Conflict:
            outcomes.append(None)

    threads = [threading.Thread(target=race, args=(m,)) for m in ("x", "y", "z")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [m for m in outcomes if m]
    assert len(outcomes) == 3 and len(won) == 1
    assert rows(store.table("files")) == sorted([("a.go", "1"), (f"{won[0]}.go", won[0])])
    # what the losers wrote is gone
    named = {x["folder"].split("/")[1] for r in (1, 2) for t in store.manifests.at(r)["tables"].values() for x in t.values()}
    assert set(store.files.names(f"{store.root}/files")) == named
    with pytest.raises(Conflict):
        store.commit(Change({"files": table(spark, "files", [("q.go", "1")])}), 1)


def test_a_commit_that_breaks_off_leaves_nothing(spark, store):
    store.commit(Change({"files": table(spark, "files", [("a.go", "1")])}), 0)
    broken = table(spark, "symbols", [("a.go", "x", "o")]).withColumn("id", F.when(F.col("id") == "x", F.raise_error("lost")).otherwise("x"))
    with pytest.raises(Exception, match="lost"):
        store.commit(Change({"files": table(spark, "files", [("a.go", "2")]), "symbols": broken}), 1)
    assert store.head()["revision"] == 1 and rows(store.table("files")) == [("a.go", "1")]


def test_a_task_that_runs_twice_leaves_no_half_version(spark, store, tmp_path):
    """The first attempt of a writing task fails after it has given rows; Spark tries again."""
    marker = str(tmp_path / "tried")

    def flaky(batches):
        for batch in batches:
            yield batch
        if not os.path.exists(marker):
            open(marker, "w").close()
            raise RuntimeError("lost")

    files = table(spark, "files", [(f"{i}.go", "1") for i in range(50)]).coalesce(1).mapInArrow(flaky, TABLES["files"])
    try:
        store.commit(Change({"files": files}), 0)
    except Exception:  # local masters try a task once; then the commit as a whole is made again
        assert store.head()["revision"] == 0
        store.commit(Change({"files": files}), 0)
    assert len(rows(store.table("files"))) == 50


def test_claims_are_whole_and_made_once(spark, tmp_path):
    files, at = Files(spark), f"{tmp_path.as_uri()}/deep er/one.json"
    done = []
    threads = [threading.Thread(target=lambda i=i: done.append((files.claim(at, str(i) * 1000), i))) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [i for ok, i in done if ok]
    assert len(won) == 1 and files.text(at) == str(won[0]) * 1000 and files.names(f"{tmp_path.as_uri()}/deep er") == ["one.json"]


@pytest.mark.parametrize(
    "codes, files, symbols, vectors, deleted",
    [
        ([], [("a.go", "1")], [("a.go", "x", None), ("a.go", "y", "o")], [("x", [1.0])], ["b.go"]),
        (["path_invalid"] * 5, [("../a", "1"), ("a//b", "1"), (None, "1")], [], [], ["/x", "./y"]),
        (["duplicate_upsert", "upsert_delete_conflict"], [("a.go", "1"), ("a.go", "2")], [], [], ["a.go"]),
        (["symbol_path_mismatch"], [("a.go", "1")], [("b.go", "x", None)], [], []),
        (["duplicate_occurrence", "duplicate_symbol_id"], [("a.go", "1")], [("a.go", "x", None), ("a.go", "x", "o"), ("a.go", "y", "o")], [], []),
        (["embedding_dimension_mismatch", "embedding_invalid_vector", "embedding_invalid_vector", "embedding_invalid_vector", "embedding_unknown_symbol"], [("a.go", "1")], [("a.go", i, i) for i in "abcde"], [("a", [1.0]), ("b", [1.0, 2.0]), ("c", []), ("d", [float("nan")]), ("e", [None]), ("q", [1.0])], []),
    ],
)
def test_faults_of_change_sets(spark, store, codes, files, symbols, vectors, deleted):
    change = Change({"files": table(spark, "files", files), "symbols": table(spark, "symbols", symbols), "embeddings": table(spark, "vectors", vectors)}, spark.createDataFrame([(d,) for d in deleted], "path string"))
    assert sorted(r.code for r in diagnostics(change).collect()) == codes
    if codes:
        with pytest.raises(Invalid):
            store.commit(change, 0)
        assert store.head()["revision"] == 0
    with pytest.raises(Invalid):
        diagnostics(Change())


def scores(index, terms=("alpha", "beta")):
    return {r.id: round(r.score, 9) for r in index.bm25(list(terms)).collect()}


def test_the_kept_index_equals_one_made_anew(spark, tmp_path):
    texts = {i: " ".join(["alpha", "beta", "gammaDelta", f"w{i}"][: 1 + i % 4] * (1 + i % 3)) for i in range(30)} | {90: "", 91: None}
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "id long, text string")
    kept = Index(spark, (tmp_path / "kept").as_uri(), {"text": 1}).refresh(frame(texts))
    steps = [{3: "alpha", 200: "beta beta", 91: "alpha"}, {200: None, 5: "none"}, {1: "alpha beta"}]
    for step in steps:
        texts = {k: v for k, v in (texts | step).items() if not (k == 200 and v is None)}
        kept.refresh(frame(texts))
        anew = Index(spark, (tmp_path / f"anew{len(texts)}-{sorted(step)[0]}").as_uri(), {"text": 1}).refresh(frame(texts))
        assert scores(kept) == scores(anew) and (kept.manifest["docs"], kept.manifest["length"]) == (anew.manifest["docs"], anew.manifest["length"])
        assert rows(kept.term_statistics()) == rows(anew.term_statistics())
    assert len(kept.manifest["segments"]) == 4
    for i in range(SEGMENTS):
        kept.apply(frame({300 + i: "alpha"}), spark.createDataFrame([(i,)], "id long"))
        texts = {k: v for k, v in (texts | {300 + i: "alpha"}).items() if k != i}
    assert len(kept.manifest["segments"]) < SEGMENTS  # they were merged
    anew = Index(spark, (tmp_path / "last").as_uri(), {"text": 1}).refresh(frame(texts))
    assert scores(kept) == scores(anew) and rows(kept.term_statistics()) == rows(anew.term_statistics())
    kept.apply(None, frame(texts).select("id"))
    assert scores(kept) == {} and kept.manifest["docs"] == 0


def test_an_index_of_unchanged_files_reads_nothing(spark, tmp_path):
    data = str(tmp_path / "docs.parquet")
    spark.createDataFrame([(1, "alpha"), (2, "beta")], "id long, text string").write.parquet(data)
    index = Index(spark, (tmp_path / "ix").as_uri(), {"text": 1})
    docs = spark.read.parquet(data)
    assert index.refresh(docs, docs).manifest["revision"] == 1
    assert index.refresh(docs, docs).manifest["revision"] == 1
    spark.createDataFrame([(2, "alpha"), (3, "alpha")], "id long, text string").write.mode("overwrite").parquet(data)
    docs = spark.read.parquet(data)
    assert index.refresh(docs, docs).manifest["revision"] == 2 and set(scores(index)) == {2, 3}
    later = Index(spark, index.root, {"text": 1})
    assert set(scores(later)) == {2, 3}
    with pytest.raises(Conflict):
        index.manifest = index.manifests.at(1)
        index.apply(docs.limit(1))
    assert set(scores(later)) == {2, 3}


def test_a_search_reads_its_terms_buckets_only(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"alpha word{i} thing{i}") for i in range(200)], "id long, text string")
    index = Index(spark, tmp_path.as_uri(), {"text": 1}).refresh(docs)
    plan = index.bm25(["alpha"])._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "(term = alpha)" in plan or "EqualTo(term,alpha)" in plan
    assert index.bm25(["alpha"]).count() == 200


def test_terms_of_fields(spark, tmp_path):
    docs = spark.createDataFrame([(1, "getUser", "the user"), (2, None, "user2 x")], "id long, name string, body string")
    index = Index(spark, tmp_path.as_uri(), {"name": 4, "body": 1}).refresh(docs)
    got = rows(index.postings())
    want = []
    for r in docs.select("id", T.tokens(F.col("name")).alias("n"), T.tokens(F.col("body")).alias("b")).collect():
        terms = r.n * 4 + r.b
        want += [(t, r.id, len(terms), terms.count(t)) for t in set(terms)]
    assert got == sorted(want)
