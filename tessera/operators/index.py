"""A kept inverted index: postings in segments, dealt to buckets by term, changed by what a commit touches."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators.lineage import Conflict, Files, Manifests, shared_folder
from tessera.operators.retrieval import B, K1

#: Folders that a segment's postings are dealt to by term.
BUCKETS = 64
#: Segments after the first at which the next change merges all.
SEGMENTS = 8
#: The term that every document has once, whatever its text.
EVERY = ""
#: Changes with the meaning of a stored index.
FORMAT = 1


def counted_terms(docs: DataFrame, id_col: str, fields: dict[str, int]) -> DataFrame:
    """(term, id, len, tf) of each document: a field's terms counted by its weight; len is their sum.

    Terms are split off in the scan, which also tells len, so that one aggregate with partial
    sums is the only shuffle. Every document has the empty term once.
    """
    found = {c: tokens(F.col(c)) for c in fields}
    entry = lambda w: lambda t: F.struct(t.alias("term"), F.lit(w).cast("long").alias("n"))
    rows = docs.select(F.col(id_col).alias("id"), *[terms.alias(f"_{c}") for c, terms in found.items()])
    size = sum((F.size(f"_{c}").cast("long") * w for c, w in fields.items()), F.lit(0).cast("long"))
    every = F.array(F.struct(F.lit(EVERY).alias("term"), F.lit(1).cast("long").alias("n")))
    entries = F.concat(every, *[F.transform(f"_{c}", entry(w)) for c, w in fields.items()])
    each = rows.select("id", size.alias("len"), F.explode(entries).alias("e")).select("id", "len", "e.term", "e.n")
    return each.groupBy("term", "id", "len").agg(F.sum("n").alias("tf"))


class Index:
    """Postings of documents in segments under `root`; each revision's manifest lists segments and totals.

    A change writes a segment with postings of new and changed documents and the ids that it
    touches; a posting counts unless a later segment touches its document. A search reads its
    terms' buckets of each segment; the number of documents and their summed length stand in
    the manifest. After SEGMENTS changes all are merged into one.
    """

    def __init__(self, spark: SparkSession, root: str, fields: dict[str, int], id_col: str = "id", buckets: int = BUCKETS):
        self.spark, self.root, self.fields, self.id_col, self.buckets = spark, root.rstrip("/"), fields, id_col, buckets
        self.manifests, self.files = Manifests(spark, root), Files(spark)
        self.manifest = self.manifests.latest()

    def _read(self, segments: list[dict], part: str) -> DataFrame:
        """A part of segments, each row with its segment's number."""
        kind = self.manifest["id_type"]
        schema = {"postings": f"term string, id {kind}, len long, tf long, bucket int", "documents": f"id {kind}, len long, hash string", "touched": f"id {kind}"}[part]
        rows = [self.spark.read.schema(schema).parquet(f"{self.root}/{s['folder']}/{part}").withColumn("segment", F.lit(s["number"])) for s in segments]
        out = rows[0] if rows else self.spark.createDataFrame([], f"{schema}, segment int")
        for more in rows[1:]:
            out = out.unionByName(more)
        return out

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows whose document no later segment touches."""
        later = self.manifest.get("segments", [])[1:]
        if not later:
            return rows.drop("segment")
        last = self._read(later, "touched").groupBy("id").agg(F.max("segment").alias("last"))
        return rows.join(last, "id", "left").where("last IS NULL OR segment >= last").drop("segment", "last")

    def documents(self) -> DataFrame:
        """(id, len, hash) of the documents that count."""
        return self._live(self._read(self.manifest.get("segments", []), "documents"))

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(term, id, len, tf) of some terms, or of all."""
        rows = self._read(self.manifest.get("segments", []), "postings")
        if terms is not None:
            mine = {r.b for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(self._bucket(F.col("t")).alias("b")).collect()}
            rows = rows.where(F.col("bucket").isin(*mine) & F.col("term").isin(*terms))
        else:
            rows = rows.where(F.col("term") != EVERY)
        return self._live(rows.drop("bucket"))

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _hashed(self, docs: DataFrame) -> DataFrame:
        return docs.select(F.col(self.id_col).alias("id"), F.sha2(F.to_json(F.struct(*self.fields)), 256).alias("hash"))

    def _segment(self, postings: DataFrame, hashes: DataFrame, touched: DataFrame | None, number: int) -> dict:
        """Write a segment aside: postings, the documents with their lengths, which the empty term's postings tell, and touched ids."""
        folder = f"segments/{number:06d}-{uuid.uuid4().hex}"
        own = postings.withColumn("bucket", self._bucket(F.col("term"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id")
        own.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.root}/{folder}/postings")
        segment = {"folder": folder, "number": number}
        lengths = self._read([segment], "postings").where((F.col("term") == EVERY) & (F.col("bucket") == self._bucket(F.lit(EVERY))))
        hashes.join(lengths.select("id", "len"), "id").select("id", "len", "hash").write.parquet(f"{self.root}/{folder}/documents")
        if touched is not None:
            touched.write.parquet(f"{self.root}/{folder}/touched")
        return segment

    def _new_segment(self, docs: DataFrame, touched: DataFrame | None, number: int) -> dict:
        return self._segment(counted_terms(docs, self.id_col, self.fields), self._hashed(docs), touched, number)

    def _totals(self, segment: dict) -> tuple[int, int]:
        return tuple(self._read([segment], "documents").agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first())

    def _publish(self, segments: list[dict], docs: int, length: int, source: str | None, new: bool = True) -> None:
        """Claim the next revision; the last segment, if new, goes where another was faster."""
        made = self.manifest | {"revision": self.manifest["revision"] + 1, "segments": segments, "docs": docs, "length": length, "source": source}
        try:
            self.manifests.publish(made)
        except Conflict:
            if new:
                self.files.remove(f"{self.root}/{segments[-1]['folder']}")
            raise
        self.manifest = made

    def apply(self, upserts: DataFrame | None = None, deleted: DataFrame | None = None, source: str | None = None) -> None:
        """Replace the documents of `upserts` and drop the ids of `deleted`; a Conflict if another change came first.

        Only these documents' texts are read. Ids come once each.
        """
        segments = self.manifest.get("segments", [])
        if not segments:
            if upserts is None:
                raise ValueError("the first change has documents")
            self.manifest["id_type"] = upserts.schema[self.id_col].dataType.simpleString()
            segment = self._new_segment(upserts, None, 0)
            self._publish([segment], *self._totals(segment), source)
            return
        empty = self.spark.createDataFrame([], f"id {self.manifest['id_type']}")
        new = upserts.select(F.col(self.id_col).alias("id")) if upserts is not None else empty
        touched = new.unionByName(deleted.select("id") if deleted is not None else empty).distinct()
        number = segments[-1]["number"] + 1
        gone = self.documents().join(touched, "id", "left_semi").agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        if upserts is None:
            none = self.spark.createDataFrame([], f"id {self.manifest['id_type']}, term string, len long, tf long, hash string")
            segment = self._segment(none.select("term", "id", "len", "tf"), none.select("id", "hash"), touched, number)
        else:
            segment = self._new_segment(upserts, touched, number)
        docs, length = self._totals(segment)
        self._publish([*segments, segment], self.manifest["docs"] - gone[0] + docs, self.manifest["length"] - gone[1] + length, source)
        if len(self.manifest["segments"]) > SEGMENTS:
            self.merge()

    def merge(self) -> None:
        """One segment of all postings that count; older segments stay for those who read earlier revisions."""
        rows = self.postings().unionByName(self.postings([EVERY]))
        segment = self._segment(rows, self.documents().drop("len"), None, self.manifest["segments"][-1]["number"] + 1)
        self._publish([segment], self.manifest["docs"], self.manifest["length"], self.manifest["source"])

    def refresh(self, docs: DataFrame, files: DataFrame | None = None) -> Index:
        """Bring the index to the rows of docs: what is new, changed or gone by id and hash of the fields, is applied.

        files: the table of files that docs comes from; if these are as they were, nothing is read.
        """
        source = _source(files) if files is not None else None
        if source is not None and source == self.manifest.get("source"):
            return self
        try:
            if not self.manifest.get("segments"):
                self.apply(docs, source=source)
                return self
            known = self.documents().select("id", F.col("hash").alias("old"), F.lit(True).alias("had"))
            both = self._hashed(docs).withColumn("has", F.lit(True)).join(known, "id", "full_outer").where("has IS NULL OR had IS NULL OR hash <> old")
            both = both.select("id", F.col("has").isNotNull().alias("has")).persist()
            try:
                n = {r.has: r.n for r in both.groupBy("has").agg(F.count("*").alias("n")).collect()}
                if n:
                    changed = docs.join(both.where("has").select(F.col("id").alias(self.id_col)), self.id_col, "left_semi")
                    self.apply(changed if n.get(True) else None, both.where("NOT has") if n.get(False) else None, source)
                elif source is not None:
                    self._publish(self.manifest["segments"], self.manifest["docs"], self.manifest["length"], source, new=False)
            finally:
                both.unpersist()
        except Conflict:
            self.manifest = self.manifests.latest()
            return self.refresh(docs, files)
        return self

    def term_statistics(self) -> DataFrame:
        """Documents and occurrences of each term."""
        return self.postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))

    def bm25(self, query: list[str]) -> DataFrame:
        """(id, score) of documents with a query term, from these terms' postings alone."""
        rows = self.postings(query)
        frequency = rows.groupBy("term").agg(F.count("*").alias("df"))  # a row for each term of the query at most
        docs, average = self.manifest.get("docs", 0), max(1.0, self.manifest.get("length", 0) / max(1, self.manifest.get("docs", 0)))
        idf = F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / average))
        return rows.join(F.broadcast(frequency), "term").groupBy("id").agg(F.sum(part).alias("score"))

    def remove(self) -> None:
        self.files.remove(self.root)


def _source(files: DataFrame) -> str:
    """What tells the files of a table apart from other or later ones."""
    each = files.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return ":".join(map(str, each.agg(F.count("*"), F.sum(F.xxhash64(*each.columns).cast("decimal(20,0)"))).first()))


def kept_index(docs: DataFrame, files: DataFrame, name: str, id_col: str, fields: dict[str, int]) -> Index:
    """The index of a named table in the shared folder, made or brought up to date; docs comes from a table of files."""
    spark = docs.sparkSession
    mark = hashlib.sha256(repr((FORMAT, BUCKETS, name, id_col, sorted(fields.items()), docs.schema[id_col].dataType.simpleString())).encode()).hexdigest()[:32]
    return Index(spark, f"{shared_folder(spark)}/tessera-kept/{mark}", fields, id_col).refresh(docs, files)
