"""Helpers that the operators share: tables, staging in the shared folder, distributed ranks."""

from __future__ import annotations

import gc
import math
import tempfile
import time
import uuid
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only where all run on one machine."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (folder or Path(tempfile.gettempdir(), "tessera-shared").as_uri()).rstrip("/")


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files that no plan refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settle(spark: SparkSession, times: int = 2, pause: float = 0.5) -> None:
    """Sweep, and give the cleaner's thread the time to drop the files, so that they don't add up with the next step's."""
    for _ in range(times):
        sweep(spark)
        time.sleep(pause)


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Cut lineage: write `df` as a table in the shared folder, in a folder for each value of `by`, and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by, compression="zstd")
    sweep(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """`df` as a table in the shared folder, dealt to buckets by `key`, so that grouping it by the key takes no shuffle."""
    spark = df.sparkSession
    name = f"tessera_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", f"{shared_folder(spark)}/tessera/{name}").saveAsTable(name)
    sweep(spark)
    out = spark.table(name)
    out.table_name, out.staged_at = name, f"{shared_folder(spark)}/tessera/{name}"
    return out


def release(*staged: DataFrame, part: str = "") -> None:
    """Remove staged tables, or the folder `part` of them, that nothing reads any more."""
    for df in staged:
        if hasattr(df, "table_name"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.table_name}")
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{df.staged_at}/{part}")
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def keyed(docs: DataFrame) -> DataFrame:
    """docs, written first unless they are the rows of files, so that each row has a place in one."""
    try:
        docs.select(row_key())
    except AnalysisException:
        return stage(docs, "rows")
    return docs


def row_key() -> Column:
    """A long unique to each row of a table of files and the same whenever it is read: a file and a place in it, hashed."""
    return F.xxhash64("_metadata.file_path", "_metadata.row_index")


def rows_of(docs: DataFrame, **columns: Column) -> DataFrame:
    """Chosen columns of docs, and row_key."""
    return keyed(docs).select(*[column.alias(name) for name, column in columns.items()], row_key().alias("row_key"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, a table of files, but for the rows whose row_key is in `gone`; only rows that may be are shuffled."""
    name = "row_key"
    while name in map(str.lower, docs.columns):
        name += "_"
    rows, gone = docs.withColumn(name, row_key()), gone.select(F.col("row_key").alias(name))
    perhaps = maybe_in(name, docs.sparkSession, key_filter(gone))
    rest = rows.where(perhaps).join(gone.hint("merge"), name, "left_anti")
    return rows.where(~perhaps).unionByName(rest.select(*rows.columns)).drop(name)


def key_filter(keys: DataFrame, bits: int = 1 << 27) -> np.ndarray:
    """One bit for each long in the only column of `keys`, in an array of fixed size.

    Rows whose key isn't in it are told apart without a shuffle; a full one only spares fewer.
    """

    def mark(batches):
        held = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) % np.uint64(bits)
            np.bitwise_or.at(held, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        word = np.flatnonzero(held.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(held.view(np.int64)[word])], ["word", "bits"])

    found = keys.mapInArrow(mark, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out.view(np.uint8)


def maybe_in(key: str, spark: SparkSession, found: np.ndarray) -> Column:
    """Whether the filter has the key's bit."""
    shared, bits = spark.sparkContext.broadcast(found), 8 * len(found)

    @F.pandas_udf("boolean")
    def test(keys: pd.Series) -> pd.Series:
        at = keys.to_numpy(np.int64).view(np.uint64) % np.uint64(bits)
        return pd.Series((shared.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool))

    return test(F.col(key))


def spread(value: Column) -> Column:
    """A pseudorandom long in [0, 2**32) that SQL engines agree on; null counts as ''."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def drawn(value: Column) -> Column:
    """A pseudorandom long in [0, 2**60) that SQL engines agree on."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


def exclusive_sums(df: DataFrame, group: list[str], order: list[str], amount: Column, out: str) -> DataFrame:
    """Running total of `amount` before each row, within `group`, by `order`.

    The first column of `order` is a spread() value: its high bits cut each group, however
    large, into buckets that sort apart; the totals of whole buckets are added before. The
    result depends on the rows alone, not on the number of buckets. `group` holds no nulls.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = min(24, math.ceil(math.log2(max(2, parts))) + 2)
    rows = df.withColumn("_bucket", F.shiftright(F.col(order[0]), 32 - bits)).withColumn("_amount", amount)
    totals = rows.groupBy(*group, "_bucket").agg(F.sum("_amount").alias("_total"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*group, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(base, [*group, "_bucket"])
        .withColumn(out, F.col("_base") + F.coalesce(F.sum("_amount").over(within), F.lit(0)))
        .drop("_bucket", "_amount", "_base")
    )
