"""What follows parsing: signatures, cut code, local resolution, summaries, and vectors from a provider in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a signature and of a symbol's code at most, calls that a summary names, texts that a provider gets at once (fixed values).
SIGNATURE, CODE, NAMED, BATCH = 280, 16_000, 5, 16
#: What ends a text that was cut.
CUT = "\n…"
IDENTIFIER = r"([\p{L}_$][\p{L}\p{N}_$]*)[^\p{L}\p{N}_$]*$"


def head(text: Column, most: int) -> Column:
    """The first `most` bytes, less what the cut leaves of a character."""
    data = text.cast("binary")
    return F.coalesce(*[F.try_validate_utf8(F.substring(data, 1, most - k).cast("string")) for k in range(4)])


def truncated(text: Column, most: int) -> Column:
    """The text, or as much of it as fits in `most` bytes with a mark that it was cut."""
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(head(text, most - len(CUT.encode())), F.lit(CUT)))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\x0B\x85\p{Z}]+|[\s\x0B\x85\p{Z}]+$", "")


def signature(code: Column) -> Column:
    """A symbol's first line up to its opening brace."""
    line = trimmed(F.regexp_extract(trimmed(F.coalesce(code, F.lit(""))), r"^([^\n\r]*)", 1))
    return truncated(F.when(F.instr(line, "{") > 0, trimmed(F.substring_index(line, "{", 1))).otherwise(line), SIGNATURE)


def local_targets(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """edges (path, dst, to_name, confidence) with targets that their own file settles, by two equi-joins.

    An unresolved edge takes the only symbol of its file that is named so, and where no symbol is, the
    only one named as the last identifier; confidence is then 1. symbols: id, name, path.
    """
    named = symbols.groupBy("path", "name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("found"))
    as_is = named.select("path", F.col("name").alias("to_name"), F.struct("n", "found").alias("whole"))
    by_end = named.select("path", F.col("name").alias("last"), F.struct("n", "found").alias("end"))
    joined = edges.withColumn("last", F.regexp_extract("to_name", IDENTIFIER, 1)).join(as_is, ["path", "to_name"], "left").join(by_end, ["path", "last"], "left")
    hit = F.coalesce("whole", "end")
    settled = F.col("dst").isNull() & F.coalesce(hit["n"] == 1, F.lit(False))
    target = F.when(settled, hit["found"]).otherwise(F.col("dst"))
    return joined.withColumns({"dst": target, "confidence": F.when(settled, 1.0).otherwise(F.col("confidence"))}).select(*edges.columns)


def summaries(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, summary) of symbols (id, name, kind, path): what and where each is, and the first names that it calls.

    A file tells how many symbols it holds. Of a symbol's distinct calls only the first few in
    order are kept as they are counted, however many there are.
    """
    names = edges.where("kind = 'calls' AND to_name <> ''").select("src", "to_name").distinct()
    first = names.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy("to_name"))).where(F.col("place") <= NAMED)
    calls = first.groupBy("src").agg(F.array_join(F.array_sort(F.collect_list("to_name")), ", ").alias("calls"))
    held = edges.where("kind = 'contains'").groupBy("src").agg(F.count("*").alias("held"))
    joined = symbols.join(calls.withColumnRenamed("src", "id"), "id", "left").join(held.withColumnRenamed("src", "id"), "id", "left")
    what = F.when(F.col("kind") == "file", F.concat(F.lit("File "), "path", F.lit(" with "), F.coalesce("held", F.lit(0)).cast("string"), F.lit(" indexed symbols")))
    what = what.otherwise(F.concat_ws(" ", "kind", "name", F.lit("em"), "path"))
    return joined.select("id", F.concat(what, F.coalesce(F.concat(F.lit("; calls "), "calls"), F.lit("")), F.lit(".")).alias("summary"))


def embedded(texts: DataFrame, embed: Callable[[list[str]], list], *, id_col: str = "id", text_col: str = "text", batch: int = BATCH) -> DataFrame:
    """(id, vector) of texts: `embed`, a function that tasks call, gets `batch` texts at once and gives as many vectors.

    Another number of vectors, or one that is empty, not finite or of another length than the
    first of its task, fails the job: no half of an index is made. Null texts are empty.
    """
    kind = texts.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = None
        for frame in frames:
            out = []
            for at in range(0, len(frame), batch):
                part = frame[text_col].iloc[at : at + batch].fillna("").tolist()
                vectors = [np.asarray(v, float) for v in embed(part)]
                if len(vectors) != len(part):
                    raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
                for v in vectors:
                    size = size or len(v)
                    if v.ndim != 1 or not len(v) or len(v) != size or not np.isfinite(v).all():
                        raise ValueError("a vector is empty, not finite or of another length")
                out += [v.tolist() for v in vectors]
            yield pd.DataFrame({"id": frame[id_col], "vector": pd.Series(out, dtype=object)})

    return texts.select(id_col, text_col).mapInPandas(run, f"id {kind}, vector array<double>")


def in_scope(facts: DataFrame, snapshot: str, document: str, version: int) -> DataFrame:
    """Facts that hold for a snapshot and a version of a document: those that name neither, or the same."""
    other = (F.coalesce("snapshot_id", F.lit("")) != "") & F.lit(snapshot != "") & (F.col("snapshot_id") != snapshot)
    elsewhere = (F.coalesce("document_id", F.lit("")) != "") & ~((F.col("document_id") == document) & F.col("document_version").eqNullSafe(version))
    return facts.where(~other & ~elsewhere)


def match_expression(terms: Column) -> Column:
    """Terms as quoted words, any of which may match, so that no text is read as a query language."""
    return F.array_join(F.transform(F.array_distinct(terms), lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))), " OR ")
