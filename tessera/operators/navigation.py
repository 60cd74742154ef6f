"""Navigation targets: merging, order and limits; point lookups of symbols and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import resolve

#: Targets shown by kind of navigation, and for any other (fixed values).
LIMITS, OTHER = {"definition": 20, "implementation": 50, "references": 500, "incoming_calls": 200, "outgoing_calls": 200}, 100
PLACE = ["relationship", "path", "first", "last", "external"]


def overlapping_groups(targets: DataFrame) -> DataFrame:
    """Adds `group`: definitions of one symbol in one file whose ranges overlap, in chains, share one.

    A running maximum of the ends marks where a new chain begins.
    """
    mine = Window.partitionBy("path", "symbol_id").orderBy("first", "last", "target_id")
    before = F.max("last").over(mine.rowsBetween(Window.unboundedPreceding, -1))
    started = targets.withColumn("new", (before.isNull() | (F.col("first") > before)).cast("int"))
    return started.withColumn("group", F.sum("new").over(mine)).drop("new")


def merged_targets(targets: DataFrame) -> DataFrame:
    """One row for each place: the most confident target's fields, and everyone's provenance.

    Rows without a path are told apart by their label too. Definitions with a symbol merge where
    their ranges overlap.
    """
    is_definition = (F.col("relationship") == "definition") & F.col("symbol_id").isNotNull()
    label = F.when(F.col("path") == "", F.col("label"))
    best = F.struct((-F.col("confidence")).alias("rank"), "target_id", "symbol_id", "label", "first", "last", "confidence")
    found = lambda rows, *key: rows.groupBy(*key).agg(F.min(best).alias("best"), F.array_sort(F.collect_set("provenance")).alias("provenance")).select(
        "relationship", "path", "external", "best.first", "best.last", "best.target_id", "best.symbol_id", "best.label", "best.confidence", "provenance"
    )
    ranged = found(overlapping_groups(targets.where(is_definition)), "relationship", "path", "external", F.col("symbol_id").alias("of"), "group")
    others = targets.where(~is_definition).select("*", label.alias("named"), F.col("first").alias("from"), F.col("last").alias("to"))
    return ranged.unionByName(found(others, "relationship", "path", "external", "named", "from", "to"))


def limited(targets: DataFrame, kind: str, asked: int = 0) -> DataFrame:
    """The first targets in order, with the total before the cut."""
    most = LIMITS.get(kind, OTHER)
    most = asked if 0 < asked <= most else most
    total = targets.agg(F.count("*").alias("total"))
    ordered = targets.orderBy("relationship", "external", "path", "first", F.col("symbol_id").asc_nulls_first(), "target_id").limit(most)
    return ordered.crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > most)  # total is one row


def confirmed(fallbacks: DataFrame, semantic: DataFrame) -> DataFrame:
    """Fallbacks whose symbol or place a semantic target has too: two equi-joins instead of an `or`."""
    by_id = fallbacks.join(semantic.where("symbol_id IS NOT NULL").select("symbol_id").distinct(), "symbol_id", "left_semi")
    by_place = fallbacks.join(semantic.select("path", "first", "last").distinct(), ["path", "first", "last"], "left_semi")
    return by_id.unionByName(by_place).distinct()


def subjects(requests: DataFrame, symbols: DataFrame, ranges: DataFrame) -> DataFrame:
    """(request, step, id, candidates): what each request is about, decided by the first thing that it names.

    requests: request, symbol_id, occurrence_id, identifier, path, line, col (null if not named).
    A symbol id counts alone, found or not; then an occurrence, whose id may be a symbol's as
    well; then an identifier, which is a subject only if one symbol answers to it (the best of
    several is given, and their number); then the tightest range around the position. A request
    that finds nothing has step `missing`, or `identifier` and no id. symbols: id, name,
    qualified, path, kind, occurrence; ranges as in resolve.at_line_column, by occurrence.
    """
    asked = requests.select("request", F.col("symbol_id").alias("ref")).where("ref IS NOT NULL")
    by_id = asked.join(symbols.select(F.col("id").alias("ref"), "id"), "ref").select("request", "id")
    placed = requests.where("symbol_id IS NULL AND occurrence_id IS NOT NULL").select("request", F.col("occurrence_id").alias("ref"))
    handles = symbols.where("occurrence IS NOT NULL").select(F.col("occurrence").alias("ref"), "id", F.lit(0).alias("way"))
    handles = handles.unionByName(symbols.select(F.col("id").cast("string").alias("ref"), "id", F.lit(1).alias("way")))
    by_place = placed.join(handles, "ref").groupBy("request").agg(F.min_by("id", "way").alias("id"))
    free = requests.where("symbol_id IS NULL AND occurrence_id IS NULL")
    by_name = resolve.resolve_scoped(free.where("identifier <> ''").select("request", F.col("identifier").alias("name"), "path"), symbols)
    points = free.where("coalesce(identifier, '') = '' AND line IS NOT NULL").select("request", "path", "line", "col")
    by_range = resolve.at_line_column(points, ranges, ["request"])
    found = by_id.withColumn("n", F.lit(1)).unionByName(by_place.withColumn("n", F.lit(1))).unionByName(by_name.select("request", F.col("target").alias("id"), "n")).unionByName(by_range.withColumn("n", F.lit(1)))
    step = (
        F.when(F.col("symbol_id").isNotNull(), "symbol").when(F.col("occurrence_id").isNotNull(), "occurrence")
        .when(F.col("identifier") != "", "identifier").when(F.col("line").isNotNull(), "position").otherwise("missing")
    )
    named = requests.select("request", step.alias("step")).join(found, "request", "left")
    out = F.when(F.col("id").isNull() & (F.col("step") != "identifier"), "missing").otherwise(F.col("step"))
    return named.select("request", out.alias("step"), "id", F.coalesce("n", F.lit(0)).cast("long").alias("candidates"))


def exact_targets(facts: DataFrame, symbols: DataFrame, ranges: DataFrame) -> DataFrame:
    """(request, target, outcome): the one symbol that a request's facts lead to.

    facts: request, identifier, path, line, col. Facts outside the workspace or without a line
    lead nowhere; the others to the tightest range's symbol, if that is named as the identifier
    and is neither a file nor an import. Several symbols are ambiguous.
    """
    inside = facts.where("path NOT LIKE '%://%' AND line >= 1")
    met = resolve.tightest(inside, ranges).select("path", "line", "col", F.col("best.id").alias("id"))
    told = met.join(symbols.select("id", "name", "kind"), "id").where("kind NOT IN ('file', 'import')").select(*[F.col(c).alias(f"_{c}") for c in ("path", "line", "col", "name")], "id")
    # places are few beside the facts that lie there, which are shuffled once
    same = (F.col("path") == F.col("_path")) & (F.col("line") == F.col("_line")) & F.col("col").eqNullSafe(F.col("_col")) & (F.col("identifier") == F.col("_name"))
    named = inside.select("request", "identifier", "path", "line", "col").join(told.hint("shuffle_hash"), same)
    found = named.groupBy("request").agg(F.count_distinct("id").alias("n"), F.min("id").alias("target"))
    each = facts.select("request").distinct().join(found, "request", "left")
    return each.select("request", F.when(F.col("n") == 1, F.col("target")).alias("target"), F.when(F.col("n") == 1, "exact").when(F.col("n") > 1, "ambiguous").otherwise("none").alias("outcome"))


def by_name(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols of this name, or whose qualified name ends with it after a dot or double colon."""
    return symbols.where((F.col("name") == name) | F.col("qualified").endswith(f".{name}") | F.col("qualified").endswith(f"::{name}"))


def incident(edges: DataFrame, symbol) -> DataFrame:
    return edges.where((F.col("src") == symbol) | (F.col("dst") == symbol))
