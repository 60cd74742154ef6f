"""Resolution of names, imports and positions to symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import directory


def resolve_names(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Targets of edges (name, path, confidence) among symbols (id, name, path, is_file).

    A candidate scores 100 in the same file, 25 in the same directory and 5 if it isn't a file;
    ties go to the smaller id. The score depends on the place alone, so the best candidate of
    each (name, path), (name, directory) and name meet the edges in three equi-joins, and a
    common name never multiplies. Confidence is 0.95 for a sole candidate, else 0.7 at least.
    """
    s = symbols.withColumn("dir", directory(F.col("path"))).withColumn("rank", F.struct(F.col("is_file"), F.col("id")))
    best = F.min("rank")
    e = edges.withColumn("dir", directory(F.col("path")))
    file_ = s.groupBy("name", "path").agg(best.alias("in_file"))
    dir_ = s.groupBy("name", "dir").agg(best.alias("in_dir"))
    name = s.groupBy("name").agg(best.alias("anywhere"), F.count("*").alias("n"))
    j = e.join(name, "name", "left").join(dir_, ["name", "dir"], "left").join(file_, ["name", "path"], "left")
    target = F.coalesce(F.col("in_file.id"), F.col("in_dir.id"), F.col("anywhere.id"))
    confidence = F.when(F.col("n") == 1, 0.95).when(F.col("n") > 1, F.greatest("confidence", F.lit(0.7))).otherwise(F.col("confidence"))
    return j.select(*[c for c in edges.columns if c != "confidence"], target.alias("target"), confidence.alias("confidence"))


def path_suffixes(files: DataFrame) -> DataFrame:
    """(suffix, path, id): each suffix of a path that begins at a segment, with and without extension."""
    parts = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    both = F.array_distinct(F.concat(tails, F.transform(tails, lambda t: F.regexp_replace(t, r"\.[^./]+$", ""))))
    return files.select(F.explode(both).alias("suffix"), "path", "id")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports (target) that are a path's suffix at a segment: the smallest (path, id), confidence 0.9."""
    winners = path_suffixes(files).groupBy("suffix").agg(F.min(F.struct("path", "id")).alias("w"))
    wanted = imports.withColumn("suffix", F.regexp_replace("target", r"^[./]+|[./]+$", "")).where("suffix <> ''")
    found = wanted.join(winners, "suffix", "left")
    return found.select(*imports.columns, F.col("w.path").alias("path"), F.col("w.id").alias("file_id"), F.when(F.col("w").isNotNull(), 0.9).alias("confidence"))


def at_position(points: DataFrame, ranges: DataFrame, bin: int = 1024) -> DataFrame:
    """The tightest range (path, first, last, id) around each point (path, pos), ties to the smaller id.

    Ranges are cut into bins of positions, so that a point of a file with many ranges only meets
    those near it.
    """
    cut = ranges.withColumn("bin", F.explode(F.sequence(F.floor(F.col("first") / bin), F.floor(F.col("last") / bin))))
    inside = points.withColumn("bin", F.floor(F.col("pos") / bin)).join(cut, ["path", "bin"]).where(F.col("pos").between(F.col("first"), F.col("last")))
    return inside.groupBy("path", "pos").agg(F.min(F.struct((F.col("last") - F.col("first")).alias("span"), "id")).alias("best")).select("path", "pos", F.col("best.id").alias("id"))


def _pieces(ranges: DataFrame, bounds: DataFrame) -> DataFrame:
    """(path, row, level, node, span, id): what a range holds whole, as nodes of binary trees.

    Each file has a tree over its lines (row -1), for those between a range's first and last one,
    and each line a tree over its columns, for its first and last line. Numbers count from the
    least of the points and end with the greatest, so that a tree is no higher than they ask for.
    """
    span = ((F.col("end_line") - F.col("start_line")).cast("long") * 100_000 + F.col("end_col") - F.col("start_col")).alias("span")
    longs = [F.col(c).cast("long").alias(c) for c in ("start_line", "start_col", "end_line", "end_col")]
    near = ranges.select("path", *longs, span, "id").where("start_line <= end_line").join(bounds, "path").where("start_line <= high_line AND end_line >= low_line")
    one = "start_line = end_line"
    between = "IF(start_line < end_line, struct(-1L AS row, greatest(start_line + 1, low_line) - low_line AS begin, least(end_line - 1, high_line) - low_line + 1 AS stop), NULL)"
    first = f"IF(start_line >= low_line AND start_col IS NOT NULL AND NOT ({one} AND end_col IS NULL), struct(start_line - low_line AS row, greatest(start_col, low_col) - low_col AS begin, IF({one}, least(end_col, high_col), high_col) - low_col + 1 AS stop), NULL)"
    last = f"IF(end_line <= high_line AND NOT {one} AND end_col IS NOT NULL, struct(end_line - low_line AS row, 0L AS begin, least(end_col, high_col) - low_col + 1 AS stop), NULL)"
    parts = near.select("path", "span", "id", F.explode(F.array(F.expr(between), F.expr(first), F.expr(last))).alias("p")).select("path", "span", "id", "p.*").where("begin < stop")
    # of each level, the nodes that lie within and whose parent does not
    levels = parts.withColumn("level", F.explode(F.expr("sequence(0, length(bin(stop - begin)) - 1)")))
    levels = levels.withColumn("low", F.expr("shiftright(begin + shiftleft(1L, level) - 1, level)")).withColumn("high", F.expr("shiftright(stop, level)")).where("low < high")
    ends = F.array(F.when(F.col("low") % 2 == 1, F.col("low")), F.when(F.col("high") % 2 == 1, F.col("high") - 1))
    return levels.select("path", "row", "level", F.explode(ends).alias("node"), "span", "id").where("node IS NOT NULL")


def tightest(places: DataFrame, ranges: DataFrame) -> DataFrame:
    """(path, line, col, best): the tightest range's span and id around each place that some range is around.

    A range is cut into nodes of trees over lines and columns that it holds whole, a few for each
    power of two of its length, and the best of each node is kept; a place meets the nodes above
    it. So ranges, however many lie around a place, never meet it one by one.
    """
    places = places.select("path", F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col")).where("path IS NOT NULL AND line IS NOT NULL").distinct()
    bounds = places.groupBy("path").agg(F.min("line").alias("low_line"), F.max("line").alias("high_line"), F.min("col").alias("low_col"), F.max("col").alias("high_col"))
    best = _pieces(ranges, bounds).groupBy("path", "row", "level", "node").agg(F.min(F.struct("span", "id")).alias("best"))
    rows = places.join(bounds, "path").withColumn("row", F.explode(F.expr("IF(col IS NULL, array(-1L), array(-1L, line - low_line))")))
    levels = rows.withColumn("level", F.explode(F.expr("sequence(0, length(bin(IF(row < 0, high_line - low_line, high_col - low_col))))")))
    above = levels.select("path", "line", "col", "row", "level", F.expr("shiftright(IF(row < 0, line - low_line, col - low_col), level)").alias("node"))
    return above.join(best, ["path", "row", "level", "node"]).groupBy("path", "line", "col").agg(F.min("best").alias("best"))


def at_line_column(points: DataFrame, ranges: DataFrame, key: list[str]) -> DataFrame:
    """The tightest range around each point, by lines and columns: key columns and id.

    points: key, path, line, col; ranges: path, start_line, start_col, end_line, end_col, id.
    Columns count only on a range's first and last line. A line weighs 100,000 columns; ties go
    to the smaller id. Points in one place are looked up once.
    """
    found = tightest(points, ranges).select(F.col("path").alias("_path"), F.col("line").alias("_line"), F.col("col").alias("_col"), "best")
    at = (F.col("path") == F.col("_path")) & (F.col("line") == F.col("_line")) & F.col("col").eqNullSafe(F.col("_col"))
    met = points.select(*dict.fromkeys([*key, "path", "line", "col"])).join(found.hint("shuffle_hash"), at)
    return met.groupBy(*key).agg(F.min("best").alias("best")).select(*key, F.col("best.id").alias("id"))


def named_keys(symbols: DataFrame) -> DataFrame:
    """Symbols once for each name they answer to: their own, and what follows the last dot or double colon of the qualified one."""
    last = F.regexp_extract("qualified", r"(?:\.|::)([\p{L}\p{N}_$]+)$", 1)
    return symbols.withColumn("key", F.explode(F.array_distinct(F.array("name", last)))).where("key <> ''")


def resolve_scoped(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """(request, target, n): the best symbol for a name seen in a path, and how many answer to it.

    requests: request, name, path. Symbols (id, name, qualified, path, kind) answer to their name
    and to the last part of the qualified one; 100 points in the same file, 25 in the same
    directory, 5 for what isn't a file; ties to the smaller id.
    """
    named = named_keys(symbols).select("id", F.col("key").alias("name"), "path", (F.col("kind") == "file").alias("is_file"))
    sole = named.groupBy("name").agg(F.count_distinct("id").alias("n"))
    found = resolve_names(requests.select("request", "name", "path", F.lit(0.0).alias("confidence")), named)
    return found.join(sole, "name").select("request", "target", "n")


def primary(occurrences: DataFrame, key: str, *order: str) -> DataFrame:
    """The first occurrence of each key, by a grouped minimum instead of a window's sort."""
    return occurrences.groupBy(key).agg(F.min(F.struct(*order)).alias("m")).select(key, "m.*")
