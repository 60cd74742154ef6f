"""The manifest of a page collection: which pages there are, in which order, and which files each covers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.symbols import base_name, is_test_path, sanitized_slug

#: Pages of a manifest at most (fixed value).
PAGES = 25
#: Layers of a module in order: slug, title, and what a file's name holds (fixed values).
LAYERS = (
    ("domain-model", "Domain model", ("model", "domain", "entity", "types")),
    ("service-layer", "Service layer", ("service", "usecase", "application")),
    ("repository-layer", "Repository layer", ("repository", "store", "persistence")),
    ("http-handler", "HTTP handler", ("http", "handler", "controller", "route")),
)


def is_frontend(name: Column, language: Column) -> Column:
    return F.contains(language, F.lit("script")) | name.startswith("web") | name.startswith("frontend") | name.startswith("apps/")


def _layer_files(files: DataFrame) -> DataFrame:
    """(module, layer, path) of modules' files (module, path) that lie in a layer by their name."""
    name = F.lower(base_name(F.col("path")))
    hits = [F.when(reduce(lambda a, k: a | F.contains(name, F.lit(k)), keys, F.lit(False)), F.lit(i)) for i, (_, _, keys) in enumerate(LAYERS, 1)]
    each = files.where(~is_test_path(F.lower("path"))).select("module", "path", F.explode(F.array_compact(F.array(*hits))).alias("layer"))
    return each.select("module", "layer", "path").distinct()


def manifest(modules: DataFrame, files: DataFrame, tests: DataFrame, most: int = PAGES) -> DataFrame:
    """(place, slug, title, kind, parent, module): the pages in order, as many as there may be.

    Overview, getting started and architecture come first; then each module by its slug, with the
    layers that its files show; then tests, if any, and the glossary. modules: module, language;
    files: module, path; tests: path.
    """
    slug = F.concat(F.lit("module-"), sanitized_slug(F.col("module")))
    numbered = modules.withColumn("of", slug).withColumn("section", F.row_number().over(Window.orderBy("of", "module")) + 2)  # a row for each module
    frontend = is_frontend(F.col("module"), F.col("language"))
    kind = F.when(frontend, "frontend").otherwise("module")
    side = F.when(frontend, "frontend").otherwise("backend")
    own = numbered.withColumn("slug", F.concat_ws("-", F.col("section").cast("string"), side, sanitized_slug(F.col("module"))))
    page = lambda df, section, layer, s, title, k, parent, module: df.select(section.alias("section"), layer.alias("layer"), s.alias("slug"), title.alias("title"), k.alias("kind"), parent.alias("parent"), module.alias("module"))
    lit, col = F.lit, F.col
    main = page(own, col("section"), lit(0), col("slug"), F.concat(F.initcap(side), lit(": "), col("module")), kind, lit("overview"), col("of"))
    seen = _layer_files(files).select("module", "layer").distinct().join(own.where(~frontend), "module")
    pick = lambda at: F.element_at(F.array(*[lit(x[at]) for x in LAYERS]), col("layer"))
    layers = page(seen, col("section"), col("layer"), F.concat(col("section").cast("string"), lit("."), col("layer").cast("string"), lit("-"), pick(0)), pick(1), lit("layer"), col("slug"), col("of"))
    counts = modules.agg(F.count("*").alias("n")).crossJoin(tests.agg((F.count("*") > 0).alias("tested"))).crossJoin(files.agg((F.count("*") > 0).alias("any")))  # three single rows
    fixed = [("overview", "Overview", "overview", ""), ("1-getting-started", "Getting started", "getting-started", "overview"), ("2-architecture-overview", "Architecture overview", "architecture-overview", "overview")]
    heads = reduce(DataFrame.unionByName, [page(counts.where("any"), lit(i), lit(0), lit(s), lit(t), lit(k), lit(p), lit("")) for i, (s, t, k, p) in enumerate(fixed)])
    testing = page(counts.where("tested"), col("n") + 3, lit(0), F.concat((col("n") + 3).cast("string"), lit("-testing")), lit("Testing"), lit("testing"), lit("overview"), lit(""))
    last = col("n") + 3 + col("tested").cast("int")
    glossary = page(counts.where("any"), last, lit(0), F.concat(last.cast("string"), lit("-glossary")), lit("Glossary"), lit("glossary"), lit("overview"), lit(""))
    every = heads.unionByName(main).unionByName(layers).unionByName(testing).unionByName(glossary)
    first = every.orderBy("section", "layer", "slug").limit(most)
    return first.withColumn("place", F.row_number().over(Window.orderBy("section", "layer", "slug")) - 1).drop("section", "layer")  # `most` rows


def manifest_scopes(pages: DataFrame, modules: DataFrame, files: DataFrame, tests: DataFrame, roots: DataFrame) -> DataFrame:
    """(slug, path): the files that each page of a manifest covers.

    Overview, architecture and glossary cover everything; getting started what lies in the root
    and the modules with an entry point, or everything if there is none; a module its files, a
    layer those of its module that show it, testing the tests. modules: module, entrypoint;
    files: module, path (all that is known); tests and roots: path.
    """
    pages = F.broadcast(pages)  # a manifest's few rows
    every = files.select("path").distinct()
    all_of = lambda kinds: pages.where(F.col("kind").isin(*kinds)).select("slug").crossJoin(every)
    slug = F.concat(F.lit("module-"), sanitized_slug(F.col("module")))
    own = files.select(slug.alias("of"), "path").distinct()
    of_module = pages.where("kind IN ('module', 'frontend')").select("slug", F.col("module").alias("of")).join(own, "of").select("slug", "path")
    number = F.coalesce(*[F.when(F.endswith(F.col("slug"), F.lit(s)), F.lit(i)) for i, (s, _, _) in enumerate(LAYERS, 1)])
    layered = _layer_files(files).select(slug.alias("of"), "layer", "path")
    of_layer = pages.where("kind = 'layer'").select("slug", F.col("module").alias("of"), number.alias("layer")).join(layered, ["of", "layer"]).select("slug", "path")
    began = roots.select("path").unionByName(files.join(modules.where("entrypoint").select("module"), "module", "left_semi").select("path")).distinct()
    start = pages.where("kind = 'getting-started'").select("slug")
    any_ = began.agg((F.count("*") > 0).alias("any"))
    of_start = start.crossJoin(began).select("slug", "path").unionByName(start.crossJoin(F.broadcast(any_)).where("NOT any").select("slug").crossJoin(every))  # pages have one such row
    of_tests = pages.where("kind = 'testing'").select("slug").crossJoin(tests.select("path").distinct())
    return reduce(DataFrame.unionByName, [all_of(["overview", "architecture-overview", "glossary"]), of_module, of_layer, of_start, of_tests])
