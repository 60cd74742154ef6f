"""Signatures, cut texts, local targets, summaries, vectors in batches and scopes on small rows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import overlay, parsed, resolve


def plain_cut(text, most):
    data = text.encode()
    if len(data) <= most:
        return text
    return data[: most - 4].decode(errors="ignore") + "\n…"


def plain_signature(code):
    code = code.strip()
    line = code.splitlines()[0] if code else ""
    line = line.strip()
    return plain_cut(line.split("{")[0].strip() if "{" in line else line, 280)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("aé中\U0001f600{ \t\n\r", max_size=300), min_size=1, max_size=20))
def test_signatures_and_cuts(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for i, sig, cut in frame.select("i", parsed.signature(F.col("t")), parsed.truncated(F.col("t"), 50)).collect():
        assert (sig, cut) == (plain_signature(texts[i]), plain_cut(texts[i], 50))


def test_local_targets_need_one_name(spark):
    symbols = spark.createDataFrame([(1, "run", "a.go"), (2, "stop", "a.go"), (3, "stop", "a.go"), (4, "run", "b.go"), (5, "x.run", "b.go")], "id long, name string, path string")
    edges = spark.createDataFrame([(1, "a.go", None, "run"), (2, "a.go", None, "pkg.run()"), (3, "a.go", None, "stop"), (4, "a.go", 9, "run"), (5, "b.go", None, "x.run"), (6, "c.go", None, "run"), (7, "a.go", None, "")], "seq long, path string, dst long, to_name string").withColumn("confidence", F.lit(0.5))
    got = {r.seq: (r.dst, r.confidence) for r in parsed.local_targets(edges, symbols).collect()}
    assert got == {1: (1, 1.0), 2: (1, 1.0), 3: (None, 0.5), 4: (9, 0.5), 5: (5, 1.0), 6: (None, 0.5), 7: (None, 0.5)}


def test_vectors_come_in_batches_or_not_at_all(spark):
    texts = spark.createDataFrame([(i, f"t{i}" if i % 7 else None) for i in range(50)], "id long, text string").coalesce(1)

    def sizes(part):
        return [[float(len(part)), 1.0] for _ in part]

    assert sorted({r.vector[0] for r in parsed.embedded(texts, sizes).collect()}) == [2.0, 16.0]
    for bad in (lambda p: [[1.0]] * (len(p) - 1), lambda p: [[float("nan")]] * len(p), lambda p: [[]] * len(p), lambda p: [[1.0] * (1 + (len(p) < 16))] * len(p)):
        with pytest.raises(Exception, match="vector"):
            parsed.embedded(texts, bad).collect()


def test_views_resolve_only_what_changes(spark):
    """Edges of names that a buffer doesn't touch keep what they had, even where that is wrong by now; the others equal a resolution of everything."""
    symbols = spark.createDataFrame([(1, "run", "a/x.go", False), (2, "run", "b/y.go", False), (3, "stop", "a/x.go", False), (4, "go", "c/z.go", False)], "id long, name string, path string, is_file boolean")
    edges = spark.createDataFrame([(n, p, 0.5) for n in ("run", "stop", "go", "new") for p in ("a/q.go", "b/y.go", "c/c.go")], "name string, path string, given double")
    before = resolve.resolve_names(edges.withColumn("confidence", F.col("given")), symbols)
    paths = spark.createDataFrame([("a/x.go",)], "path string")
    buffer = spark.createDataFrame([(3, "stop", "a/x.go", False), (9, "new", "a/x.go", False)], "id long, name string, path string, is_file boolean")
    view, got = overlay.resolved_view(before, symbols, paths, buffer, edges.limit(0))
    whole = resolve.resolve_names(edges.withColumn("confidence", F.col("given")), view)
    columns = ["name", "path", "given", "target", "confidence"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect()))
    assert {r.name for r in overlay.changed_names(symbols, buffer, paths).collect()} == {"run", "new"}


def test_states_of_buffers(spark):
    rows = [("same", "a", "now", "h"), ("moved", "a", "old", "h"), ("stale", "a", "old", "other"), ("new", "gone", "old", "other"), ("bare", "a", "", "other")]
    overlays = spark.createDataFrame(rows, "document string, path string, base_snapshot string, base_hash string").withColumns({"version": F.lit(3), "content_hash": F.lit("c")})
    got = {r.document: (r.state, r.view is None) for r in overlay.composite_states(overlays, spark.createDataFrame([("a", "h")], "path string, hash string"), "now").collect()}
    assert got == {"same": ("current", False), "moved": ("rebased", False), "stale": ("stale", True), "new": ("rebased", False), "bare": ("current", False)}
