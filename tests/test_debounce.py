"""Requests of a stream against those of a batch."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.streaming import debounce, hints

SCHEMA = "root string, ts timestamp, sequence long, path string, operations int, kind string, reason string"


def hint(ms, sequence, path="a/x.go", operations=2, kind="unknown", reason="", root="r"):
    return (root, datetime(2024, 1, 1) + timedelta(milliseconds=ms), sequence, path, operations, kind, reason)


#: Ends every request before it.
END = hint(10_000_000, 10**9, root="end")


def streamed(spark, tmp_path, parts, **options):
    """Rows that the stream gives, a file of hints for each batch."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        own = max((p for p in (tmp_path / "in").glob("part-*")), key=lambda p: p.stat().st_mtime_ns)
        own.rename(tmp_path / "in" / f"{i:03}.parquet")
        import os

        os.utime(tmp_path / "in" / f"{i:03}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"out{random.randrange(10**9)}"
    q = debounce.stream_requests(rows, **options).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(240)
    finally:
        q.stop()
    return sorted(tuple(r) for r in spark.table(name).collect())


def batch(spark, rows, quiet, most):
    table = spark.createDataFrame(rows, SCHEMA)
    found = hints.coalesced_paths(hints.requests(hints.meaningful(table), quiet, most)).where("root <> 'end'")
    return sorted(tuple(r) for r in found.select("root", "request", "path", "operations", "kind", "reason", "sequence").collect())


@pytest.mark.parametrize("pieces", [1, 3])
def test_the_stream_equals_the_batch(spark, tmp_path, pieces):
    rng = random.Random(4)
    rows = [hint(rng.randrange(9000), k, f"p{rng.randrange(4)}", rng.choice([1, 2, 4, 16]), rng.choice(["unknown", "file", ""]), rng.choice(["", "editor"]), f"r{rng.randrange(3)}") for k in range(120)]
    rows += [hint(200 * i, 1000 + i, root="busy") for i in range(30)]
    rows.sort(key=lambda r: (r[1], r[2]))
    at = [len(rows) * i // pieces for i in range(pieces + 1)]
    parts = [rows[i:j] for i, j in zip(at, at[1:])]
    got = streamed(spark, tmp_path, [*parts, [END]], quiet=0.25, most=1.0, buffer=10_000)
    assert got == batch(spark, rows, 0.25, 1.0) and len({r[:2] for r in got}) > 30


def test_hints_out_of_order_and_late_ones(spark, tmp_path):
    one = [hint(0, 1, "a"), hint(400, 3, "b"), hint(5000, 9, "c")]
    two = [hint(200, 2, "d"), hint(5100, 10, "e")]  # 200 belongs to the request of 1, which the batch between has given out
    got = streamed(spark, tmp_path, [one, [hint(5050, 50, root="other")], two, [END]], quiet=0.25, most=2.0, settle=0.0, late=100.0)
    assert ("r", 0, "", hints.RESCAN, "unknown", "late", 2) in got
    assert [(r[1], r[2]) for r in got if r[0] == "r" and r[1]] == [(1, "a"), (2, "b"), (3, "c"), (3, "e")]


def test_hints_wait_for_others_to_settle(spark, tmp_path):
    one, two = [hint(0, 1, "a"), hint(400, 3, "b"), hint(5000, 9, "c")], [hint(200, 2, "d"), hint(5100, 10, "e")]
    got = streamed(spark, tmp_path, [one, two, [END]], quiet=0.25, most=2.0, settle=10.0, late=100.0)
    assert [(r[1], r[2]) for r in got] == [(1, "a"), (1, "b"), (1, "d"), (2, "c"), (2, "e")]


def test_too_many_hints_become_a_rescan(spark, tmp_path):
    rows = [hint(i, i, f"p{i}") for i in range(300)] + [hint(9000, 400, "later")]
    got = streamed(spark, tmp_path, [rows, [END]], quiet=0.25, most=2.0, buffer=256)
    assert got[0][1:] == (1, "", hints.RESCAN, "unknown", "overflow", 0)
    scoped = hints.scopes(spark.createDataFrame([r for r in got if r[1] == 1], "root string, request long, path string, operations int, kind string, reason string, sequence long"))
    assert scoped.select(F.col("mode")).first()[0] == "full"


def test_more_hints_in_a_batch_than_may_wait(spark, tmp_path):
    # 600 hints of 60 requests in one batch: all but the last have ended by its newest hint
    rows = [hint(5000 * (i // 10) + i % 10, i, f"p{i % 3}") for i in range(600)]
    got = streamed(spark, tmp_path, [rows, [END]], quiet=0.25, most=2.0, buffer=256)
    assert got == batch(spark, rows, 0.25, 2.0) and len({r[1] for r in got}) == 60
    # what no newer hint settles waits as before
    waits = streamed(spark, tmp_path / "again", [rows, [END]], quiet=0.25, most=2.0, settle=4000.0, late=4000.0, buffer=256)
    assert [r[5] for r in waits] == ["overflow"] * 2


@pytest.mark.parametrize("parts", [0, 3])
def test_a_table_of_many_hints_is_read_whole(spark, tmp_path, parts):
    from tessera.queries import QUERIES, read

    # more than 100,000 hints of a root, in one file or in a folder of files
    events = read(spark, "/root/testdata/sf0.01", "events").where("event_id < 3000")
    many = events.crossJoin(spark.range(60)).selectExpr("event_id * 60 + id AS event_id", "ts", "user_id * 4 AS user_id", "'click' AS event_type", "value", "props").coalesce(max(1, parts))
    if parts:
        many = many.repartition(parts)
        many.write.parquet(str(tmp_path / "events.parquet"))
    else:
        many.write.parquet(str(tmp_path / "folder"))
        next((tmp_path / "folder").glob("part-*.parquet")).rename(tmp_path / "events.parquet")
    got, batched = QUERIES["streamed_requests"](spark, str(tmp_path)), QUERIES["coalesced_hints"](spark, str(tmp_path))
    closed = batched.where(F.col("request") < batched.agg(F.max("request")).first()[0]).select("root", "request", "path", F.col("operations").cast("int"), "kind", "reason", "sequence")
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in closed.collect()) and got.count() > 1000
