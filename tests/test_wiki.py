"""Manifests, canonical packs and scans on small tables and folders."""

import random

from pyspark.sql import functions as F

from tessera.operators import canonical, wiki
from tessera.sources import files, reconcile


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_manifest_of_a_small_workspace(spark):
    modules = spark.createDataFrame([("cmd/api", "go", True), ("web", "typescript", False)], "module string, language string, entrypoint boolean")
    own = spark.createDataFrame([("cmd/api", "cmd/api/main.go"), ("cmd/api", "cmd/api/user_store.go"), ("cmd/api", "cmd/api/http_test.go"), ("web", "web/app.ts"), ("root", "README.md")], "module string, path string")
    tests = spark.createDataFrame([("cmd/api/http_test.go",)], "path string")
    pages = wiki.manifest(modules, own, tests)
    assert [r.slug for r in pages.orderBy("place").collect()] == ["overview", "1-getting-started", "2-architecture-overview", "3-backend-cmd-api", "3.3-repository-layer", "4-frontend-web", "5-testing", "6-glossary"]
    assert [r.slug for r in wiki.manifest(modules, own, tests, 4).orderBy("place").collect()] == ["overview", "1-getting-started", "2-architecture-overview", "3-backend-cmd-api"]
    scopes = wiki.manifest_scopes(pages, modules, own, tests, own.where("module = 'root'").select("path"))
    by = {}
    for slug, path in rows(scopes):
        by.setdefault(slug, []).append(path)
    assert by["3.3-repository-layer"] == ["cmd/api/user_store.go"] and by["5-testing"] == ["cmd/api/http_test.go"] and len(by["overview"]) == 5
    assert by["1-getting-started"] == ["README.md", "cmd/api/http_test.go", "cmd/api/main.go", "cmd/api/user_store.go"]
    none = wiki.manifest_scopes(pages, modules.withColumn("entrypoint", F.lit(False)), own, tests, own.limit(0).select("path"))
    assert none.where("slug = '1-getting-started'").count() == 5
    assert wiki.manifest(modules.limit(0), own.limit(0), tests.limit(0)).count() == 0


def test_hashes_of_packs_depend_on_content_alone(spark):
    packs = spark.createDataFrame([(1, "hover", None, "v1"), (2, "hover", None, "v1")], "pack int, feature string, target string, policy string")
    evidence = [(p, f"ev:{i}", r, f"h{i}") for p in (1, 2) for i, r in enumerate((0.5, 1.0, 0.5, 0.0))]
    edges, left = [(p, "a", "b", k) for p in (1, 2) for k in ("calls", "reads")], [(p, "budget", x) for p in (1, 2) for x in ("x", None)]

    def hashes(shuffled=False, change=None):
        ev = [(*e[:3], "other") if e == change else e for e in evidence]
        if shuffled:
            for x in (ev, edges, left):
                random.Random(3).shuffle(x)
        found = canonical.pack_hashes(packs, spark.createDataFrame(ev, "pack int, evidence_id string, relevance double, content_hash string").repartition(3), spark.createDataFrame(edges, "pack int, src string, dst string, kind string"), spark.createDataFrame(left, "pack int, reason string, ref string"))
        return {r.pack: r.hash for r in found.collect()}

    plain = hashes()
    assert plain[1] == plain[2] and hashes(True) == plain
    other = hashes(change=evidence[0])
    assert other[1] != plain[1] and other[2] == plain[2]


def test_dependencies_repeat_without_effect(spark):
    deps = [("a", "symbol", "s", "p", "h"), ("a", "file", None, "p", "h"), ("b", "file", None, "p", "h"), ("b", "symbol", "s", "p", "h"), ("b", "symbol", "s", "p", "h")]
    found = {r.artifact: r.hash for r in canonical.dependency_hashes(spark.createDataFrame(deps, "artifact string, kind string, symbol string, path string, content_hash string"), "artifact").collect()}
    assert found["a"] == found["b"] and found["a"].startswith("ctx:") and len(found["a"]) == 36


def test_scans_of_lists_and_subtrees(spark):
    known = spark.createDataFrame([("a/x.go", "1"), ("a/y.go", "1"), ("a/d/z.go", "1"), ("b.go", "1"), ("vendor/q.go", "1"), ("c.txt", "1"), ("u.go", "1")], "path string, content_hash string")
    there = spark.createDataFrame([("a/x.go", "2", 1), ("a/d", "9", 1), ("b.go", "1", 1), ("vendor/q.go", "1", 1), ("c.txt", "1", 1), ("n.go", "1", 1), ("u.go", None, 1), ("big.go", "1", 9)], "path string, content_hash string, size long")
    full = {r.path: (r.change, r.reason) for r in reconcile.reconcile(known, there, most_bytes=5).collect()}
    assert full == {"a/x.go": ("changed", ""), "a/y.go": ("deleted", "removed"), "a/d/z.go": ("deleted", "removed"), "vendor/q.go": ("deleted", "became_ignored"), "c.txt": ("deleted", "became_unsupported"), "n.go": ("added", "")}
    assert rows(reconcile.reconcile(known, there, subtree="a/d")) == [("a/d/z.go", "deleted", "removed")]
    assert rows(reconcile.reconcile(known, there, paths=spark.createDataFrame([("a/y.go",), ("b.go",), ("zz",)], "path string"))) == [("a/y.go", "deleted", "removed")]
    changes = reconcile.reconcile(known, there, most_bytes=5)
    kept = {r.path: (r.change, r.reason) for r in reconcile.quarantined(changes, spark.createDataFrame([("a/x.go", "odd"), ("a/y.go", "odd")], "path string, error string")).collect()}
    assert kept["a/x.go"] == ("quarantined", "odd") and kept["a/y.go"] == ("deleted", "removed")


def test_ignored_folders_are_never_opened(spark, tmp_path):
    for name, text in (("a.go", "package a"), ("src/b b.py", "x"), ("node_modules/c.go", "x"), ("src/gen/d.go", "x"), ("src/[e].go", "y"), ("f.txt", "x"), ("big.go", "x" * 99)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "node_modules").chmod(0o000)
    try:
        for root in (str(tmp_path), tmp_path.as_uri()):
            assert [f.rpartition("/")[2] for f in files.listed(spark, root, ["gen"])] == ["a.go", "big.go", "[e].go", "b b.py"]
            assert [(r[0], r[1], r[2]) for r in rows(files.scan(spark, root, ["gen"], 50).select("path", "language", "size"))] == [("a.go", "go", 9), ("src/[e].go", "go", 1), ("src/b b.py", "python", 1)]
    finally:
        (tmp_path / "node_modules").chmod(0o755)
    (tmp_path / "none").mkdir()
    assert files.scan(spark, str(tmp_path / "none")).count() == 0


def test_ignore_rules(spark):
    """Patterns with a slash fit from the root, others any segment; stars and classes stay within a segment."""
    cases = {
        ("gen",): {"gen/a.go": True, "x/gen/a.go": True, "gene/a.go": False, "x/gen": True},
        ("/build.go",): {"build.go": True, "x/build.go": True},
        ("a/b",): {"a/b": True, "a/b/c.go": True, "x/a/b": False, "a/bc": False},
        ("docs/*.go",): {"docs/a.go": True, "docs/x/a.go": False, "x/docs/a.go": False},
        ("*.py",): {"a.py": True, "x/y/a.py": True, "a.pyc": False},
        ("[ab]?.go",): {"a1.go": True, "c1.go": False, "x/b2.go": True, "a12.go": False},
        ("[^a].go",): {"b.go": True, "a.go": False},
        ("src/**/x.go",): {"src/a/x.go": True, "src/a/b/x.go": False},
        ("# gen", "!gen", "", " / "): {"gen/a.go": False},
        (): {"node_modules/a.go": True, "x/vendor/a.go": True, "vendored/a.go": False},
    }
    for patterns, paths in cases.items():
        frame = spark.createDataFrame([(p,) for p in paths], "path string")
        got = {r.path: r.hit for r in frame.select("path", files.ignored(F.col("path"), list(patterns)).alias("hit")).collect()}
        assert got == paths, patterns
