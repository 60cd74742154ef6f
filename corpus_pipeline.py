"""A training-data pipeline over `documents`, each stage by one of the operators of tessera.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.mixing import mix_sources
from tessera.llm.packing import pack_documents
from tessera.llm.pii import redact, train_model
from tessera.llm.quality import classify
from tessera.llm.shared import exclusive_sums, keyed, row_key, rows_of, spread, stage, table, without
from tessera.llm.similarity import jaccard_components

#: SQL has neither the language model nor the tokenizer.
ORACLE_SQL = None
#: A whole copy of a document, in units of shares.
ONE = 1 << 32


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go."""
    docs = keyed(docs)
    return without(docs, classify(docs, table(spark, sf_dir, "labels")).where("NOT keep"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike in 0.8 of their five-word shingles, one row stays; so does every row without words."""
    docs = keyed(docs)
    rows = rows_of(docs, text=F.col("text"))
    found = jaccard_components(rows, id_col="row_key", words=5, percent=80)
    return without(docs, found.where("doc_id <> component_id").select(F.col("doc_id").alias("row_key")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind in brackets."""
    cleaned = redact(docs, train_model(docs))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def _copies(documents: DataFrame) -> DataFrame:
    """(row, times): whole copies of each document, for the words that the mix takes of its source.

    Shares of taken words add up along a pseudorandom order of the documents of a source and of
    one power of two of sizes; a document comes once for each whole number that the sum passes.
    So documents of like size stand for each other, and a source's words come near its target.
    """
    shares = documents.where("taken > 0").withColumn("share", F.expr(f"taken * {ONE} div size"))
    shares = shares.withColumn("of", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("scale", F.floor(F.log2("size"))).withColumn("h", spread(F.col("doc_id")))
    placed = exclusive_sums(shares, ["of", "scale"], ["h", "doc_id", "size", "row"], F.col("share"), "before")
    passed = lambda x: F.floor((x + ONE // 2) / F.lit(ONE))
    return placed.select("row", (passed(F.col("before") + F.col("share")) - passed(F.col("before"))).cast("int").alias("times")).where("times > 0")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes in whole copies, none to two or three, so that each source's words come near its target."""
    docs = keyed(docs)
    rows = rows_of(docs, doc_id=F.col("doc_id"), text=F.col("text"), source=F.col("source"))
    copies = _copies(mix_sources(rows, row_col="row_key").documents)
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("document"), row_key().alias("row"))
    return whole.join(copies, "row").select("document", F.explode(F.sequence(F.lit(1), "times"))).select("document.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, packed by best fit."""
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
