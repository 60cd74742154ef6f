"""What an evidence pack begins with: package directories, definitions of each file first, usage windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.symbols import is_exported
from tessera.functions.text import directory

#: Definitions that a pack begins with, and lines around a usage site.
SEEDS, AROUND = 19, 2


def module_lines(files: DataFrame) -> DataFrame:
    """(module, dir, path, place): what go.mod files (path, content) say they are."""
    lines = files.where("(path = 'go.mod' OR path LIKE '%/go.mod') AND content <> ''").select("path", F.posexplode(F.split(F.replace("content", F.lit("\r\n"), F.lit("\n")), "\n")).alias("place", "line"))
    fields = F.filter(F.split("line", r"\s+"), lambda w: w != "")
    named = lines.withColumn("f", fields).where("size(f) = 2 AND f[0] = 'module'")
    return named.select(F.regexp_replace(F.col("f")[1], "/$", "").alias("module"), directory(F.col("path")).alias("dir"), "path", "place")


def package_directories(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports (import_path) with `dir`: where a module of the workspace has them; others are left out.

    Each import meets modules by all of its leading segments, in an equi-join; of several the
    first by path and line of the go.mod counts. Import paths are normal: segments between single slashes.
    """
    parts = F.split("import_path", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    asked = imports.select("import_path").where("import_path <> ''").distinct().select("import_path", F.explode(heads).alias("module"))
    best = asked.join(module_lines(files), "module").groupBy("import_path").agg(F.min(F.struct("path", "place", "module", "dir")).alias("m"))
    rest = F.expr("substring(import_path, length(m.module) + 2)")
    at = F.when(rest == "", F.col("m.dir")).when(F.col("m.dir") == ".", rest).otherwise(F.concat("m.dir", F.lit("/"), rest))
    return imports.join(best.select("import_path", at.alias("dir")), "import_path")


def definition_priority(name: Column, kind: Column) -> Column:
    return F.when(kind.isin("test", "interface"), 0).when(kind.isin("type", "class"), 1).when((kind == "function") & name.startswith("New"), 2).when(kind == "method", 3).otherwise(4)


def _public(name: Column, kind: Column) -> Column:
    return is_exported(name) & ~kind.isin("file", "import", "test")


def package_seeds(targets: DataFrame, symbols: DataFrame, most: int = SEEDS) -> DataFrame:
    """(target, place, id): definitions of the package in a target's directory, the first of each file, then public ones.

    targets: target, dir; symbols: id, name, kind, path. By priority (10 more if not public), path,
    name and id within a file; the files' first ones by path, the rest by the same order over all.
    """
    n, k = F.col("name"), F.col("kind")
    exported = (k == "test") | _public(n, k)
    own = symbols.where("kind NOT IN ('file', 'import') AND name <> ''").select("id", "name", "path", directory(F.col("path")).alias("dir"), exported.alias("exported"), (definition_priority(n, k) + F.when(exported, 0).otherwise(10)).alias("priority"))
    order = ["priority", "path", "name", "id"]
    met = targets.join(own, "dir").withColumn("in_file", F.row_number().over(Window.partitionBy("target", "path").orderBy(*order)))
    first = F.col("in_file") == 1
    key = F.struct((~first).alias("later"), F.when(first, 0).otherwise(F.col("priority")).alias("p"), "path", "name", "id")
    ranked = met.where(first | F.col("exported")).withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy(key)))
    return ranked.where(F.col("place") <= most).select("target", "place", "id")


def member_seeds(targets: DataFrame, symbols: DataFrame, most: int = SEEDS) -> DataFrame:
    """(target, place, id): symbols of a type's directory whose qualified name goes through the type's.

    targets: target (an id), name, qualified, path; symbols: id (its own), name, qualified, kind,
    path. What a qualified name goes through ends before a dot, so symbols meet the names that are
    asked for in an equi-join, by stretches of their lengths; of each name in a directory the first
    are kept, one more than a target shows as it may be itself among them.
    """
    n, k = F.col("name"), F.col("kind")
    own = symbols.where("id IS NOT NULL AND contains(qualified, '.')").select("id", "name", F.col("qualified").alias("full"), "path", directory(F.col("path")).alias("dir"), (definition_priority(n, k) + F.when(_public(n, k), 0).otherwise(10)).alias("priority"))
    asked = targets.select("target", F.col("name").alias("type"), F.col("qualified").alias("owner"), directory(F.col("path")).alias("dir"))
    names = asked.select("dir", F.explode(F.array("type", "owner")).alias("through")).where("through <> ''").distinct()
    lengths = names.groupBy("dir").agg(F.collect_set(F.length("through")).alias("lengths"))
    dots = "filter(sequence(1, length(full)), i -> substring(full, i, 1) = '.')"
    through = f"array_distinct(flatten(transform({dots}, i -> transform(filter(lengths, n -> n < i), n -> substring(full, i - n, n)))))"
    met = own.join(lengths, "dir").withColumn("through", F.explode(F.expr(through))).drop("lengths").join(names, ["dir", "through"])
    order = ["priority", "path", "name", "id"]
    first = met.withColumn("rank", F.dense_rank().over(Window.partitionBy("dir", "through").orderBy(*order))).where(F.col("rank") <= most + 1).drop("rank")
    by_type = asked.select("target", "dir", F.col("type").alias("through"), F.lit(None).cast("string").alias("but"))
    by_owner = asked.select("target", "dir", F.col("owner").alias("through"), F.when(F.col("type") != "", F.concat("type", F.lit("."))).alias("but"))
    # what an owner has beyond what its type has
    found = by_type.unionByName(by_owner).join(first, ["dir", "through"]).where("id <> target AND NOT coalesce(contains(full, but), false)")
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy(*order)))
    return ranked.where(F.col("place") <= most).select("target", "place", "id")


def usage_windows(sites: DataFrame, files: DataFrame, around: int = AROUND) -> DataFrame:
    """(site, first, last, content, hash): lines around a place of use; none beyond the file or where all is blank.

    sites: site, path, line; files: path, code.
    """
    lines = F.split(F.replace("code", F.lit("\r\n"), F.lit("\n")), "\n")
    met = sites.where("path <> '' AND line >= 1").join(files.where("code <> ''"), "path").withColumn("lines", lines).where("line <= size(lines)")
    first, last = F.greatest(F.col("line") - around, F.lit(1)), F.least(F.col("line") + around, F.size("lines"))
    content = F.regexp_replace(F.array_join(F.slice("lines", first.cast("int"), (last - first + 1).cast("int")), "\n"), r"^\s+|\s+$", "")
    found = met.select("site", first.alias("first"), last.alias("last"), content.alias("content")).where("content <> ''")
    return found.withColumn("hash", F.substring(F.sha2("content", 256), 1, 24))
