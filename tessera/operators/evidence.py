"""Evidence packs: policy scores, merging of candidates, order, budgets and the compact graph."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import within_budget


class Policy(NamedTuple):
    """What a surface adds to a candidate's fused rank, and what it may spend."""

    target: float
    relations: dict[str, float]
    near: float  # over the distance
    weak: float  # taken off below a confidence of 0.3
    max_bytes: int
    reserve: int
    each: int
    most: int
    nodes: int
    edges: int


#: Weights and budgets by surface (fixed values).
POLICIES = {
    "base": Policy(1.0, {}, 0.2, 0.1, 16000, 2000, 2000, 20, 30, 60),
    "hover": Policy(2.0, {"usage_site": 1.2, "package_api": 0.8, "parent": 0.9, "calls": 0.7, "called_by": 0.5, "imports": 0.3, "child": 0.2}, 0.1, 0.2, 6000, 2000, 1400, 9, 8, 12),
    "see_more": Policy(3.0, {"definition": 1.4, "usage_site": 1.2, "tests": 1.6, "parent": 1.0, "calls": 0.9, "called_by": 0.8, "implements": 0.6, "references": 0.6, "imports": 0.4, "child": 0.3}, 0.3, 0.2, 28000, 6000, 3200, 21, 24, 40),
    "codemap": Policy(1.5, {"calls": 0.8, "called_by": 0.8, "implements": 0.6, "references": 0.6, "parent": 0.3, "child": 0.3, "imports": 0.1}, 0.2, 0.0, 40000, 6000, 1600, 40, 40, 80),
    "deepwiki": Policy(0.0, {"calls": 0.5, "called_by": 0.5, "implements": 0.5, "references": 0.5, "imports": 0.1}, 0.2, 0.0, 36000, 8000, 2000, 32, 40, 60),
}
RANK_CONSTANT = 60.0


def score(surface: str) -> Column:
    """What the policy adds, from is_target, relation, distance, confidence, kind, symbol_kind and source."""
    p, c = POLICIES[surface], F.col
    total = F.when(c("is_target"), p.target).otherwise(0.0)
    total += reduce(lambda w, x: w.when(c("relation") == x[0], x[1]), p.relations.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    total += F.when(c("distance") > 0, p.near / c("distance")).otherwise(0.0)
    total -= F.when(c("confidence") < 0.3, p.weak).otherwise(0.0)
    if surface == "base":
        total -= F.when((c("kind") == "ast_observation") & c("symbol_kind").isin("file", "import"), 0.15).otherwise(0.0)
    if surface == "see_more":
        total -= F.when((c("source") == "semantic_candidate") & (c("relation") == ""), 0.4).otherwise(0.0)
    if surface == "deepwiki":
        total += F.when(c("kind") == "ast_observation", 1.0).when(c("kind") == "config", 1.4).otherwise(0.0)
        total -= F.when(c("distance") > 0, 0.3).otherwise(0.0)
    return total


def merged(candidates: DataFrame, surface: str, request: str = "request") -> DataFrame:
    """One row for each evidence of a request: the first of its candidates, the least distance, all provenance, its relevance.

    Relevance is the reciprocal ranks of the lists that hold it, 1 for the target and the
    policy's score, within 0 and 1.
    """
    ranks = sum((F.when(F.col(r) > 0, 1 / (RANK_CONSTANT + F.col(r))).otherwise(0.0) for r in ("lexical_rank", "dense_rank", "package_rank")), F.when(F.col("is_target"), 1.0).otherwise(0.0))
    scored = candidates.withColumn("relevance", F.greatest(F.lit(0.0), F.least(F.lit(1.0), ranks + score(surface))))
    row = F.struct("seq", *[c for c in scored.columns if c not in ("seq", request, "evidence_id", "provenance", "distance")])
    one = scored.groupBy(request, "evidence_id").agg(F.min_by(row, "seq").alias("row"), F.min("distance").alias("distance"), F.array_sort(F.collect_set("provenance")).alias("provenance"))
    return one.select(request, "evidence_id", "row.*", "distance", "provenance")


#: More relevant, nearer, then by place and id.
ORDER = (F.desc, "relevance"), (F.asc, "distance"), (F.asc, "path"), (F.asc, "line"), (F.asc, "symbol_id"), (F.asc, "evidence_id")


def admitted(pack: DataFrame, surface: str, request: str = "request") -> DataFrame:
    """Adds rank, size and accepted: what the budget of each request admits in order, targets always."""
    p = POLICIES[surface]
    room, most = p.max_bytes - p.reserve if p.max_bytes > p.reserve else p.max_bytes, p.most
    rank = F.row_number().over(Window.partitionBy(request).orderBy(*[by(c) for by, c in ORDER]))
    size = (F.least(F.octet_length("content"), F.lit(p.each)) + F.octet_length("title")).cast("long")
    rows = pack.withColumn("rank", rank.cast("long")).withColumn("size", size)
    return within_budget(rows, request, room, most)


def compact_graph(pack: DataFrame, edges: DataFrame, surface: str, request: str = "request") -> DataFrame:
    """(request, seq, src, dst, kind): edges between the admitted symbols of each pack, the first ones in order."""
    nodes = pack.where("accepted").select(request, "symbol_id").distinct()
    ends = edges.join(nodes.select(request, F.col("symbol_id").alias("src")), "src").join(nodes.select(request, F.col("symbol_id").alias("dst")), [request, "dst"])
    place = F.row_number().over(Window.partitionBy(request).orderBy("seq"))
    return ends.withColumn("place", place).where(F.col("place") <= POLICIES[surface].edges).select(request, "seq", "src", "dst", "kind")
