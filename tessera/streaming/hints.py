"""Change hints: noise filter, coalescing within debounce sessions, scope escalation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operation bits (fixed values).
CREATE, WRITE, REMOVE, RENAME, CHMOD, RESCAN = 1, 2, 4, 8, 16, 32


def meaningful(hints: DataFrame) -> DataFrame:
    """Hints that are more than a change of metadata."""
    return hints.where(F.col("operations") != CHMOD)


def coalesced(hints: DataFrame, gap: str = "10 minutes", by: str = "root") -> DataFrame:
    """One request for each quiet-delimited session: batch or stream, the same plan.

    hints: root, path, ts, sequence, operations. Watched roots debounce apart, so that sessions
    spread over the cluster; a stream needs a watermark on ts.
    """
    return hints.groupBy(by, F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("hints"), F.bit_or("operations").alias("operations"),
        F.min("sequence").alias("min_sequence"), F.max("sequence").alias("max_sequence"),
    ).select(by, F.col("w.start").alias("started"), "hints", "operations", "min_sequence", "max_sequence")


def scope(operations: Column) -> Column:
    """full where a rescan is required, subtree after a rename, else paths."""
    has = lambda bit: operations.bitwiseAND(bit) != 0
    return F.when(has(RESCAN), "full").when(has(RENAME), "subtree").otherwise("paths")


def requests(hints: DataFrame, gap: float, cap: float) -> DataFrame:
    """Adds `request`: the number, within its root, of the flush that takes a hint.

    A request ends once no hint has come for `gap` seconds, and `cap` seconds after its first at
    the latest. The hints of a root stream through one task in order, with two times as state.
    """
    rows = hints.repartition(F.col("root")).withColumn("at", F.unix_micros("ts")).sortWithinPartitions("root", "ts", "sequence")
    quiet, most = round(gap * 1e6), round(cap * 1e6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, first, last, number = None, 0, 0, 0
        for batch in batches:
            out = []
            for own, at in zip(batch.column("root").to_pylist(), batch.column("at").to_pylist()):
                if own != root or number == 0:
                    root, first, number = own, at, 1
                elif at >= last + quiet or at >= first + most:
                    first, number = at, number + 1
                last = at
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "request"])

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{fields}, request long").drop("at")


def coalesced_paths(numbered: DataFrame) -> DataFrame:
    """One hint for each path of a request: all operations, the least sequence, the first kind and reason that say something."""
    kind = F.min_by("kind", F.when(~F.col("kind").isin("", "unknown"), F.col("sequence")))
    reason = F.min_by("reason", F.when(F.col("reason") != "", F.col("sequence")))
    first = F.min_by("kind", "sequence")
    return numbered.groupBy("root", "request", "path").agg(F.bit_or("operations").alias("operations"), F.coalesce(kind, first).alias("kind"), F.coalesce(reason, F.lit("")).alias("reason"), F.min("sequence").alias("sequence"))


def scopes(coalesced: DataFrame) -> DataFrame:
    """What a request reconciles: full, a subtree below its hints' common directory, or single paths.

    A rescan or a change of the root's ignore file takes everything; a directory, a rename or a
    nested ignore file the common directory of all paths, and everything if there is none.
    """
    c, name = F.col, F.regexp_extract("path", r"([^/]*)$", 1)
    full = (c("operations").bitwiseAND(RESCAN) != 0) | (c("path") == ".gitignore")
    wide = (c("kind") == "directory") | (c("operations").bitwiseAND(RENAME) != 0) | (name == ".gitignore")
    parent = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    grouped = coalesced.groupBy("root", "request").agg(
        F.max(full).alias("full"), F.max(wide).alias("wide"), F.min(parent).alias("low"), F.max(parent).alias("high"),
        F.min("sequence").alias("min_sequence"), F.max("sequence").alias("max_sequence"), F.count("*").alias("paths"),
    )
    # what the least and the greatest path share, all share
    equal = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size("low"), F.size("high")))), lambda i: F.slice("low", F.lit(1), i) == F.slice("high", F.lit(1), i))
    common = F.array_join(F.slice("low", F.lit(1), F.coalesce(F.array_max(equal), F.lit(0))), "/")
    mode = F.when(c("full") | (c("wide") & (common == "")), "full").when(c("wide"), "subtree").otherwise("paths")
    return grouped.withColumn("mode", mode).withColumn("common", F.when(c("mode") == "subtree", common).otherwise("")).drop("full", "wide", "low", "high")


def stream_requests(hints: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """The streaming form: watermark, filter, sessions, scope."""
    timed = meaningful(hints).withWatermark("ts", late)
    return coalesced(timed, gap).withColumn("mode", scope(F.col("operations")))
