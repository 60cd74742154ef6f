"""Bounded neighbourhoods and aggregates of an edge table (idx, src, dst, kind)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def neighbourhood(edges: DataFrame, seeds: list, depth: int = 2, most: int = 40) -> DataFrame:
    """(node, level) around the seeds, undirected, in edge order, `most` nodes at most.

    A level joins the frontier, never over `most` rows, with the edges; of the new nodes the
    first in order of (frontier place, edge) stay. The frontier is a few ids by construction.
    """
    spark: SparkSession = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    both = edges.selectExpr("idx", "src AS a", "dst AS b").unionByName(edges.selectExpr("idx", "dst AS a", "src AS b")).where("b IS NOT NULL")
    visited, frontier = {}, []
    for s in dict.fromkeys(seeds):
        if len(visited) < most:
            visited[s] = 0
            frontier.append(s)
    for level in range(1, depth + 1):
        if not frontier or len(visited) >= most:
            break
        here = F.broadcast(spark.createDataFrame(list(enumerate(frontier)), f"place int, a {kind}"))
        new = both.join(here, "a").where(~F.col("b").isin(*visited)).groupBy("b").agg(F.min(F.struct("place", "idx")).alias("at"))
        frontier = [r.b for r in new.orderBy("at").limit(most - len(visited)).collect()]
        visited |= dict.fromkeys(frontier, level)
    return spark.createDataFrame(list(visited.items()), f"node {kind}, level int")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between nodes; unresolved outgoing edges (no dst) stay."""
    inside = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
    resolved = inside.where("dst IS NOT NULL").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    return resolved.unionByName(inside.where("dst IS NULL")).select("idx", "src", "dst", "kind")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, calls): edge endpoints, and those of calls, of each node."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), "kind").where("node IS NOT NULL")
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum((F.col("kind") == "calls").cast("long")).alias("calls"))


def roots(edges: DataFrame) -> DataFrame:
    """Nodes that call and are not called."""
    calls = edges.where("kind = 'calls'")
    return calls.select(F.col("src").alias("node")).distinct().join(calls.select(F.col("dst").alias("node")), "node", "left_anti")


def seed_relations(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, relation) of seeds' neighbours: the label of the last edge that has one."""
    s = seeds.select("node", F.lit(True).alias("is_seed"))
    e = edges.join(s.withColumnsRenamed({"node": "src", "is_seed": "from_seed"}), "src", "left").join(s.withColumnsRenamed({"node": "dst", "is_seed": "to_seed"}), "dst", "left")
    out, into = F.col("from_seed") & F.col("to_seed").isNull(), F.col("to_seed") & F.col("from_seed").isNull()
    kind = F.col("kind")
    label = (
        F.when(out & (kind == "calls"), "calls").when(out & (kind == "contains"), "child").when(out & (kind == "imports"), "imports")
        .when(into & (kind == "calls"), "called_by").when(into & (kind == "contains"), "parent")
    )
    named = e.select("idx", F.when(out, F.col("dst")).otherwise(F.col("src")).alias("node"), label.alias("relation")).where("relation IS NOT NULL AND node IS NOT NULL")
    return named.groupBy("node").agg(F.max_by("relation", "idx").alias("relation"))


def within_budget(rows: DataFrame, request: str, budget: int, most: int) -> DataFrame:
    """Rows (request, rank, size, is_target) plus accepted: what a budget admits, in rank order.

    A row that doesn't fit is passed over and uses nothing; targets always enter. A request's
    rows stream through one task in order, with running totals only.
    """
    ordered = rows.repartition(F.col(request)).sortWithinPartitions(request, "rank")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used, taken = None, 0, 0
        for batch in batches:
            out = []
            for key, size, target in zip(*(batch.column(c).to_pylist() for c in (request, "size", "is_target"))):
                if at is None or key != at[0]:
                    at, used, taken = (key,), 0, 0
                ok = bool(target) or (taken < most and used + size <= budget)
                used, taken = used + size * ok, taken + ok
                out.append(ok)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], [*batch.schema.names, "accepted"])

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return ordered.mapInArrow(fold, f"{fields}, accepted boolean")
