"""Integrity of a snapshot: rules and their violations, impact of a commit, edge folding and ids, overlays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Languages and edge kinds that are valid, and segments that a path must not have (fixed values).
LANGUAGES = ("go", "javascript", "javascriptreact", "typescript", "typescriptreact", "swift", "python", "rust", "dockerfile", "dotenv", "gomod", "json", "makefile", "markdown", "text")
EDGE_KINDS = ("contains", "calls", "imports", "inherits", "implements")
MOST_VIOLATIONS = 1000


def _broken(rows: DataFrame, entity: str, ref: str, **rules: Column) -> DataFrame:
    """(entity, code, ref): each rule that a row breaks, in one pass."""
    codes = F.array_compact(F.array(*[F.when(bad, code) for code, bad in rules.items()]))
    return rows.select(F.lit(entity).alias("entity"), F.explode(codes).alias("code"), F.col(ref).cast("string").alias("ref"))


def _known(rows: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """rows with a flag whether `key` is among the keys (one column)."""
    flag = keys.select(F.col(keys.columns[0]).alias(key), F.lit(True).alias(name)).distinct()
    return rows.join(flag, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def violations(files: DataFrame, symbols: DataFrame, edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(entity, code, ref) of every broken invariant; each table is read once, lookups are equi-joins."""
    c, size = F.col, vectors.agg(F.min_by(F.size("vector"), "id").alias("dimension"))
    file_rules = _broken(files, "file", "path", file_language=~c("language").isin(*LANGUAGES), file_size_negative=c("size") < 0, file_path_format=c("path").startswith("/") | c("path").contains("../"))
    own = symbols.join(files.select("path", c("language").alias("file_language")), "path", "left")
    symbol_rules = _broken(
        own, "symbol", "id", symbol_orphan=c("file_language").isNull(), symbol_language=c("language") != c("file_language"),
        symbol_range=(c("start_line") <= 0) | (c("start_line") > c("end_line")), symbol_name_kind=(c("name") == "") | (c("kind") == ""),
    )
    ends = _known(_known(_known(edges, symbols.select("id"), "src", "has_src"), symbols.select("id"), "dst", "has_dst"), files.select("path"), "path", "has_path")
    edge_rules = _broken(
        ends, "edge", "seq", edge_from_missing=~c("has_src"), edge_to_missing=c("dst").isNotNull() & ~c("has_dst"), edge_unresolved=c("dst").isNull() & (c("to_name") == ""),
        edge_path_missing=(c("path") != "") & ~c("has_path"), edge_type=~c("kind").isin(*EDGE_KINDS), edge_confidence=c("confidence").isNull() | F.isnan("confidence") | (c("confidence") < 0) | (c("confidence") > 1),
    )
    held = _known(vectors, symbols.select("id"), "id", "has_symbol").crossJoin(F.broadcast(size))  # one row
    finite = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    vector_rules = _broken(held, "embedding", "id", embedding_orphan=~c("has_symbol"), embedding_dimension=F.size("vector") != c("dimension"), embedding_non_finite=~finite)
    return reduce(DataFrame.unionByName, (symbol_rules, edge_rules, vector_rules), file_rules)


def capped(found: DataFrame, most: int = MOST_VIOLATIONS) -> DataFrame:
    """The first `most` violations in order, and a marker with both numbers if there are more."""
    total = found.agg(F.count("*").alias("n")).where(F.col("n") > most)
    marker = total.select(F.lit("state").alias("entity"), F.lit("truncated").alias("code"), F.concat(F.lit(f"{most} of "), F.col("n").cast("string")).alias("ref"))
    return found.orderBy("entity", "code", "ref").limit(most).unionByName(marker)


def descendants(parents: DataFrame, seeds: DataFrame) -> DataFrame:
    """Ids reachable from seeds (id) over (id, parent): one join for each level, until one brings nothing new."""
    found = front = seeds.select("id").distinct()
    while True:
        front = cut(parents.join(front.select(F.col("id").alias("parent")), "parent").select("id").distinct().join(found, "id", "left_anti"))
        if front.isEmpty():
            return found
        found = cut(found.unionByName(front))


def touched_relations(edges: DataFrame, symbols: DataFrame, paths: list[str]) -> DataFrame:
    """Relations whose evidence lies in the paths, or whose subject or object does: three semi-joins."""
    own = symbols.where(F.col("path").isin(*paths)).select("id").distinct()
    ends = [edges.join(own.withColumnRenamed("id", k), k, "left_semi") for k in ("src", "dst")]
    parts = [edges.where(F.col("path").isin(*paths)), *ends]
    return reduce(DataFrame.unionByName, (p.select("kind", "src", "dst", "to_name") for p in parts)).distinct()


def folded_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Relations of edges: a known target is resolved, a name alone external, neither is no relation.

    The highest confidence within 0 and 1 counts; evidences are distinct by name, path and line.
    """
    ids = symbols.select("id")
    known = _known(_known(edges, ids, "src", "has_src"), ids, "dst", "has_dst").where("has_src AND kind <> ''")
    target = F.when(F.col("has_dst"), F.col("dst"))
    rows = known.select("kind", "src", target.alias("object"), F.when(target.isNull(), F.col("to_name")).alias("external"), "to_name", "path", "line", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")).alias("confidence"))
    rows = rows.where("object IS NOT NULL OR external <> ''")
    out = rows.groupBy("kind", "src", "object", "external").agg(F.max("confidence").alias("confidence"), F.count_distinct("to_name", "path", "line").alias("evidences"))
    return out.withColumn("resolution", F.when(F.col("object").isNotNull(), "resolved").otherwise("external"))


def valid_targets(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges that keep a target which exists; a dangling one is cleared."""
    known = _known(edges, symbols.select("id"), "dst", "has_dst")
    return known.withColumn("dst", F.when(F.col("has_dst"), F.col("dst"))).drop("has_dst")


def repaired_ids(edges: DataFrame, rank) -> DataFrame:
    """Edges with ids 1 to N by their structural key where any id repeats or isn't positive, else as they are.

    rank(rows, order, out) numbers rows over all tasks.
    """
    bad = edges.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id <= 0 OR id IS NULL").isEmpty()
    return edges if bad else rank(edges.drop("id"), ["path", "line", "kind", "src", "dst", "to_name"], "id")


def overlaid(base: DataFrame, new: DataFrame, path: str) -> DataFrame:
    """A view in which one file's rows give way to those of its open buffer."""
    return base.where(F.col("path") != path).unionByName(new.where(F.col("path") == path))


def revalidated(dependencies: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Dependencies (artifact, kind, ref, hash) with `fresh`: the file has that hash, the symbol exists."""
    file = files.select(F.col("path").alias("ref"), F.col("hash").alias("now"), F.lit("file").alias("kind"))
    symbol = symbols.select(F.col("id").cast("string").alias("ref"), F.lit("").alias("now"), F.lit("symbol").alias("kind"))
    joined = dependencies.join(file.unionByName(symbol), ["kind", "ref"], "left")
    fresh = F.col("now").isNotNull() & ((F.col("kind") == "symbol") | (F.col("hash") == "") | (F.col("hash") == F.col("now")))
    return joined.withColumn("fresh", fresh).drop("now")


def ranked_ids(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """Numbers from 1 in a global order, without one task for all rows: ranges are sorted, and each adds the sizes of those before it."""
    parts = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # a row a task
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(base), "_part").withColumn(out, F.col("_base") + within).drop("_part", "_base")
