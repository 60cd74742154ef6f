"""Change sets and their atomic commits to versioned tables of rows by path."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import normal_path
from tessera.operators.lineage import Conflict, Files, Manifests
from tessera.operators.snapshot import bucket_digests, upserted

__all__ = ["Change", "Conflict", "Invalid", "Store", "diagnostics"]

#: Hexadecimal digits of a path's hash that choose its bucket: 256 buckets; 3 where one would grow beyond what a commit should rewrite.
DIGITS = 2


class Invalid(ValueError):
    """A change set with faults; they are its argument."""


@dataclass(frozen=True)
class Change:
    """What a commit changes.

    upserts: rows by table, each with its path; a table `files` lists the paths that get new rows,
    and all earlier rows of these go from every table. deleted: (path) of files that go. replaced:
    tables without a path that are exchanged as a whole.
    """

    upserts: dict[str, DataFrame] = field(default_factory=dict)
    deleted: DataFrame | None = None
    replaced: dict[str, DataFrame] = field(default_factory=dict)

    def touched(self) -> DataFrame | None:
        parts = [df.select("path") for name, df in self.upserts.items() if name == "files"] + ([self.deleted.select("path")] if self.deleted is not None else [])
        return None if not parts else (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).distinct()


def diagnostics(change: Change) -> DataFrame:
    """(code, path, ref) of everything that forbids a commit.

    upserts may hold files (path), symbols (path, id, occurrence or null) and embeddings
    (id, vector). Paths must be in canonical form; a path comes once and isn't deleted as well;
    rows belong to a file of the change; occurrence ids, and ids of symbols without one, come
    once, and no id has both forms; vectors belong to symbols of the change, hold finite numbers
    only, and are of one length.
    """
    files, symbols, vectors = (change.upserts.get(n) for n in ("files", "symbols", "embeddings"))
    found: list[DataFrame] = []

    def say(df: DataFrame, code: str, path: Column | str, ref: Column | str) -> None:
        col = lambda c: F.col(c) if isinstance(c, str) else c
        found.append(df.select(F.lit(code).alias("code"), col(path).cast("string").alias("path"), F.coalesce(col(ref).cast("string"), F.lit("")).alias("ref")))

    canonical = F.coalesce(F.regexp_replace("path", r"\\", "/") == normal_path(F.col("path")), F.lit(False))
    for df in (files, change.deleted):
        if df is not None:
            say(df.where(~canonical), "path_invalid", "path", F.lit(""))
    if files is not None:
        say(files.groupBy("path").count().where("count > 1"), "duplicate_upsert", "path", F.lit(""))
        if change.deleted is not None:
            say(change.deleted.select("path").distinct().join(files.select("path").distinct(), "path", "left_semi"), "upsert_delete_conflict", "path", F.lit(""))
    if symbols is not None:
        own = files.select("path").distinct() if files is not None else symbols.select("path").limit(0)
        say(symbols.join(own, "path", "left_anti"), "symbol_path_mismatch", "path", "id")
        ids = symbols.groupBy("id").agg(F.count_if(F.col("occurrence").isNull()).alias("bare"), F.count("occurrence").alias("placed"), F.min("path").alias("path"))
        say(ids.where("bare > 1 OR bare > 0 AND placed > 0"), "duplicate_symbol_id", "path", "id")
        twice = symbols.where("occurrence IS NOT NULL").groupBy("occurrence").agg(F.count("*").alias("n"), F.min("path").alias("path"))
        say(twice.where("n > 1"), "duplicate_occurrence", "path", "occurrence")
    for name, df in change.upserts.items():
        if name not in ("files", "symbols") and "path" in df.columns:
            say(df.join(files.select("path").distinct(), "path", "left_anti") if files is not None else df, "row_path_mismatch", "path", F.lit(name))
    if vectors is not None:
        known = symbols.select("id").distinct() if symbols is not None else vectors.select("id").limit(0)
        say(vectors.join(known, "id", "left_anti"), "embedding_unknown_symbol", F.lit(""), "id")
        finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
        good = F.coalesce((F.size("vector") > 0) & finite, F.lit(False))
        say(vectors.where(~good), "embedding_invalid_vector", F.lit(""), "id")
        sizes = vectors.where(good).agg(F.min(F.size("vector")).alias("a"), F.max(F.size("vector")).alias("b"))
        say(sizes.where("a <> b"), "embedding_dimension_mismatch", F.lit(""), F.lit(""))
    if not found:
        raise Invalid(["empty"])
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


class Store:
    """Tables in numbered revisions, of which a commit makes the next one or nothing.

    A table's rows lie in buckets by the hash of their path. A commit writes the buckets that it
    touches anew, aside, and then claims the next number with a manifest that names a folder and a
    digest for each bucket; readers see what a manifest names. So a task that runs twice, or a
    commit that breaks off, leaves nothing in any revision, and of two commits from the same
    revision one gets a Conflict. What a commit reads and writes follows the buckets it touches.
    """

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, str], digits: int = DIGITS):
        self.spark, self.root, self.tables, self.digits = spark, root.rstrip("/"), tables, digits
        self.manifests, self.files = Manifests(spark, root), Files(spark)

    def head(self) -> dict:
        return self.manifests.latest()

    def _columns(self, name: str) -> list[str]:
        return [f.split()[0] for f in self.tables[name].split(",")]

    def _key(self, name: str) -> Column:
        """What a row's bucket depends on: its path, or its first column in a table without one."""
        columns = self._columns(name)
        return F.coalesce(F.col("path" if "path" in columns else columns[0]).cast("string"), F.lit(""))

    def _bucket(self, name: str) -> Column:
        return F.substring(F.sha2(F.concat_ws("\x00", F.lit(name), self._key(name)), 256), 1, self.digits)

    def _rows(self, name: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.tables[name])
        return self.spark.read.schema(self.tables[name]).parquet(*[f"{self.root}/{x}" for x in folders])

    def table(self, name: str, revision: int | None = None) -> DataFrame:
        """A table's rows in a revision, the newest if none is named."""
        manifest = self.head() if revision is None else self.manifests.at(revision)
        return self._rows(name, sorted({x["folder"] for x in manifest.get("tables", {}).get(name, {}).values()}))

    def _written(self, name: str, rows: DataFrame) -> dict[str, dict]:
        """Write rows aside: folder and digest of each bucket."""
        columns, folder = self._columns(name), f"{name}/{uuid.uuid4().hex}"
        own = rows.select(*columns, self._bucket(name).alias("_bucket"))
        own.hint("rebalance", "_bucket").write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{self.root}/{folder}")
        back = self.spark.read.schema(f"{self.tables[name]}, _bucket string").parquet(f"{self.root}/{folder}")
        digests = bucket_digests(back, name, self._key(name), F.to_json(F.struct(*columns)), self.digits)
        return {r.bucket: {"folder": f"{folder}/_bucket={r.bucket}", "digest": r.digest} for r in digests.collect()}  # one row a bucket

    def commit(self, change: Change, expected: int) -> dict:
        """Apply the change to revision `expected`; the new manifest, or the old one if nothing changes.

        Raises Invalid for a faulty change and Conflict if `expected` is no longer the newest.
        """
        head = self.head()
        if head["revision"] != expected:
            raise Conflict(f"revision is {head['revision']}, not {expected}")
        faults = diagnostics(Change({**change.upserts, **change.replaced}, change.deleted)).limit(1000).collect()
        if faults:
            raise Invalid([tuple(f) for f in faults])
        touched = change.touched()
        tables = {n: dict(head.get("tables", {}).get(n, {})) for n in self.tables}
        made: list[str] = []
        try:
            for name in self.tables:
                if name in change.replaced:
                    tables[name], gone = {}, []
                    new = change.replaced[name]
                elif touched is not None and "path" in self._columns(name):
                    gone = [r.b for r in touched.select(self._bucket(name).alias("b")).distinct().collect()]  # as many as buckets at most
                    old = self._rows(name, [tables[name][b]["folder"] for b in gone if b in tables[name]])
                    new = change.upserts.get(name, old.limit(0)).select(*old.columns)
                    new = upserted(old, new, touched.join(new.select("path").distinct(), "path", "left_anti"))
                else:
                    continue
                for b in gone:
                    tables[name].pop(b, None)
                found = self._written(name, new)
                made += [x["folder"].rpartition("/")[0] for x in list(found.values())[:1]]
                tables[name] |= found
            digest = hashlib.sha256("".join(f"{n}:{b}:{x['digest']}" for n in sorted(tables) for b, x in sorted(tables[n].items())).encode()).hexdigest()
            if digest == head.get("snapshot"):
                return head
            manifest = {"revision": expected + 1, "snapshot": digest, "tables": tables}
            self.manifests.publish(manifest)
            made = []
            return manifest
        finally:
            for folder in made:
                self.files.remove(f"{self.root}/{folder}")

    def remove(self) -> None:
        self.files.remove(self.root)
