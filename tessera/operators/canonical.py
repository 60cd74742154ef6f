"""Ids and hashes that depend on content alone: evidence, packs, dependencies; and the merge of semantic evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import framed_hash
from tessera.operators.snapshot import running_digests

#: Version of the canonical form, part of every hash.
FORM = "1"
#: Relevance of a type where it is the primary evidence, of other semantic evidence then, and of everything else (fixed values).
PRIMARY, OTHERS, REST = 1.0, 0.7, 0.99


def evidence_id(kind: Column, path: Column, place: Column, symbol: Column, occurrence: Column, content_hash: Column) -> Column:
    """From what an evidence refers to and its content, never from where it stands in a list."""
    return F.concat(F.lit("ev:"), framed_hash(kind, path, place, symbol, occurrence, content_hash, digits=20))


def _line(*fields: Column) -> Column:
    return F.concat_ws("\x00", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])


def pack_hashes(packs: DataFrame, evidence: DataFrame, edges: DataFrame, omissions: DataFrame) -> DataFrame:
    """(pack, hash, id): one hash over everything that a pack says, whatever the order of its rows.

    packs: pack, feature, target, policy; evidence: pack, evidence_id, relevance, content_hash;
    edges: pack, src, dst, kind; omissions: pack, reason, ref. Rows become lines of one canonical
    text: the head, evidence by falling relevance and id, edges and omissions in order. The
    lines of a pack stream through a running hash.
    """
    falling = F.format_string("%012d", (1_000_000_000 - F.round(F.col("relevance") * 1_000_000_000)).cast("long"))
    head = packs.select("pack", F.lit(0).alias("part"), F.lit("").alias("by"), _line(F.lit(FORM), F.col("feature"), F.col("target"), F.col("policy")).alias("line"))
    parts = [
        evidence.select("pack", F.lit(1).alias("part"), F.concat_ws("\x00", falling, "evidence_id").alias("by"), _line(F.col("evidence_id"), falling, F.col("content_hash")).alias("line")),
        edges.select("pack", F.lit(2).alias("part"), _line(F.col("src"), F.col("dst"), F.col("kind")).alias("by"), _line(F.col("src"), F.col("dst"), F.col("kind")).alias("line")),
        omissions.select("pack", F.lit(3).alias("part"), _line(F.col("reason"), F.col("ref")).alias("by"), _line(F.col("reason"), F.col("ref")).alias("line")),
    ]
    rows = head
    for more in parts:
        rows = rows.unionByName(more)
    marked = rows.select("pack", "part", "by", F.concat(F.col("part").cast("string"), F.lit(":"), "line").alias("line"))
    ordered = marked.repartition(F.col("pack")).sortWithinPartitions("pack", "part", "by", "line").select("pack", "line")
    found = running_digests(ordered, "lines", b"\n")
    return found.select("pack", F.concat(F.lit("sha256:"), "digest").alias("hash"), F.concat(F.lit("ctxpack:"), F.substring("digest", 1, 16)).alias("id"))


def dependency_hashes(dependencies: DataFrame, by: str) -> DataFrame:
    """(by, hash): over the distinct dependencies (kind, symbol, path, content_hash) of an artifact in order of kind, symbol and content."""
    once = dependencies.select(by, "kind", "symbol", "path", "content_hash").distinct()
    order = ["kind", "symbol", "content_hash", "path"]
    text = F.concat(*[x for c in ("kind", "symbol", "content_hash") for x in (F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\x00"))])
    rows = once.repartition(F.col(by)).sortWithinPartitions(by, *order).select(by, text.alias("text"))
    return running_digests(rows, "dependencies").select(by, F.concat(F.lit("ctx:"), F.substring("digest", 1, 32)).alias("hash"))


def with_semantic(ranked: DataFrame, semantic: DataFrame, request: str = "request", primary_first: bool = True) -> DataFrame:
    """Ranked candidates and semantic evidence of each request (both with relation and relevance), told apart by `semantic`.

    Where types come first, a type has relevance 1, other semantic evidence 0.7 at most, and in
    a request that has a type everything else 0.99 at most.
    """
    capped = F.col("relevance")
    if primary_first:
        capped = F.when(F.col("relation") == "type", PRIMARY).otherwise(F.least("relevance", F.lit(OTHERS)))
    both = ranked.withColumn("semantic", F.lit(False)).unionByName(semantic.withColumn("relevance", capped).withColumn("semantic", F.lit(True)))
    if not primary_first:
        return both
    primary = semantic.where("relation = 'type'").select(request).distinct().withColumn("primary", F.lit(True))
    joined = both.join(primary, request, "left")
    rest = F.when(~F.col("semantic") & F.col("primary").isNotNull(), F.least("relevance", F.lit(REST))).otherwise(F.col("relevance"))
    return joined.withColumn("relevance", rest).drop("primary")
