"""Snapshots: change detection, commits, integrity, digests, facts and artifacts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changes(known: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change) between two tables of (path, content_hash): added, changed or removed."""
    old = known.select("path", F.struct("content_hash").alias("old"))
    j = old.join(current.select("path", F.struct("content_hash").alias("new")), "path", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return j.select("path", change.alias("change")).where("change IS NOT NULL")


def upserted(base: DataFrame, new: DataFrame, deleted: DataFrame, key: str = "path") -> DataFrame:
    """The next version: rows of untouched keys, and the new ones."""
    touched = new.select(key).unionByName(deleted.select(key)).distinct()
    return base.join(touched, key, "left_anti").unionByName(new)


def relations(evidence: DataFrame, key: list[str]) -> DataFrame:
    """One relation for each key with the highest confidence and the number of its evidences."""
    return evidence.groupBy(*key).agg(F.max("confidence").alias("confidence"), F.count("*").alias("evidences"))


def fused_facts(facts: DataFrame, key: list[str], most: int = 32) -> DataFrame:
    """Relations from several sources: support, ranking confidence, conflict and truncation.

    facts: key, seq, fact_id, source, method, path, line, col, confidence, version_known,
    document_version, conflict. Of facts that repeat an id the first counts, and where the id is
    null or empty, of those of one source and place; by source, method, path and id the
    first `most` are kept, and only these make the confidence. Conflicts halve it; a version
    that is given but not known caps it at 0.6.
    """
    fields = ("source", "method", "path", "confidence", "version_known", "document_version")
    named = F.coalesce(F.col("fact_id").cast("string"), F.lit(""))
    place = F.concat_ws("\x00", F.coalesce("source", F.lit("")), F.coalesce("path", F.lit("")), "line", "col")
    facts = facts.withColumn("of", F.when(named != "", F.concat(F.lit("id"), named)).otherwise(F.concat(F.lit("at"), place)))
    once = facts.groupBy(*key, "of").agg(F.min_by(F.struct(*fields, "fact_id"), "seq").alias("fact"), F.max("conflict").alias("conflict")).select(*key, "of", "fact.*", "conflict")
    place = F.row_number().over(Window.partitionBy(*key).orderBy("source", "method", "path", "fact_id", "of"))
    kept = once.withColumn("place", place).where(F.col("place") <= most)
    every = once.groupBy(*key).agg(F.count("*").alias("n"), F.max("conflict").alias("conflict"))
    doubtful = F.max(~F.col("version_known") & (F.col("document_version") != 0))
    found = kept.groupBy(*key).agg(F.count("*").alias("support"), F.max("confidence").alias("best"), doubtful.alias("doubtful")).join(every, key)
    halved = F.when(F.col("conflict"), F.col("best") * 0.5).otherwise(F.col("best"))
    ranked = F.when(F.col("doubtful"), F.least(halved, F.lit(0.6))).otherwise(halved)
    return found.select(*key, "support", ranked.alias("ranking_confidence"), "conflict", (F.col("n") > most).alias("truncated"))


def correlated(relations: DataFrame) -> DataFrame:
    """Evidence rows of calls, those known by name alone moved to a resolved call of the same subject and name.

    relations: subject, object (null if unresolved), name, evidence. Names are compared without
    case; of several resolved ones the smallest object takes the evidence.
    """
    resolved = relations.where("object IS NOT NULL").groupBy("subject", F.lower("name").alias("low")).agg(F.min("object").alias("found"))
    joined = relations.withColumn("low", F.lower("name")).join(resolved, ["subject", "low"], "left")
    return joined.select("subject", F.coalesce("object", "found").alias("object"), F.when(F.col("object").isNull() & F.col("found").isNull(), F.col("name")).alias("external"), "evidence")


def bucket_digests(rows: DataFrame, section: str, key: Column, content: Column, digits: int = 2) -> DataFrame:
    """(bucket, digest, leaves): buckets by the first digits of the key's hash (256 of them), leaves in order.

    A leaf is the hash of a row; a bucket's digest covers its sorted leaves. They stream through
    a running hash, so that a bucket of any size takes no memory.
    """
    leaf = F.sha2(F.concat_ws("\x00", F.lit(section), key, content), 256)
    of = F.substring(F.sha2(F.concat_ws("\x00", F.lit(section), key), 256), 1, digits)
    leaves = rows.select(of.alias("bucket"), leaf.alias("leaf")).repartition(F.col("bucket")).sortWithinPartitions("bucket", "leaf")

    return running_digests(leaves, "leaves")


def running_digests(rows: DataFrame, count: str, between: bytes = b"") -> DataFrame:
    """(key, digest, count) of rows (key, text) that lie in order, a key in one partition: a hash over each key's texts as they stream by."""
    key, text = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = lambda at, digest, n: pa.RecordBatch.from_arrays([pa.array([at], kind), pa.array([digest.hexdigest()]), pa.array([n])], [key, "digest", count])
        at, digest, n, kind = None, None, 0, None
        for batch in batches:
            kind = batch.column(0).type
            for own, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if at is None or own != at[0]:
                    if at is not None:
                        yield done(at[0], digest, n)
                    at, digest, n = (own,), hashlib.sha256(), 0
                elif between:
                    digest.update(between)
                digest.update(value.encode())
                n += 1
        if at is not None:
            yield done(at[0], digest, n)

    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, digest string, {count} long")


def root_digest(buckets: DataFrame) -> DataFrame:
    """One row: the hash over at most 256 bucket digests in order."""
    pairs = F.array_sort(F.collect_list(F.concat_ws(":", "bucket", "digest")))
    return buckets.agg(F.sha2(F.array_join(pairs, ""), 256).alias("root"))


def orphans(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return parents.join(children.select(key), key, "left_anti")


def heads(artifacts: DataFrame, key: list[str], revision: str) -> DataFrame:
    """The latest revision of each key and the number of the next."""
    latest = F.max_by(F.struct(*[c for c in artifacts.columns if c not in key]), revision)
    return artifacts.groupBy(*key).agg(latest.alias("h")).select(*key, "h.*", (F.col(f"h.{revision}") + 1).alias("next_revision"))


def stale(dependencies: DataFrame, changed: DataFrame) -> DataFrame:
    """Artifacts with a dependency (kind, ref) among the changed ones, and their reasons."""
    hit = dependencies.join(changed.distinct(), ["kind", "ref"], "left_semi")
    return hit.groupBy("artifact").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("reasons"))
