"""What happens to results after a commit: own writes, artifacts and their heads, evaluation, page order, diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.lineage import cut

from tessera.functions.symbols import base_name

#: Phrases that count as guessing (fixed values).
SPECULATION = ("probably", "possibly", "there may be", "there is no evidence")
#: White space at the ends of a line.
BLANK = r"[\t-\r \x{85}\x{A0}\p{Z}]"
#: Severities of diagnostics from the worst (fixed values).
SEVERITIES = ("error", "warning", "info", "hint")
#: Priority of a project file by lower-case name, or by name and any ending (fixed values).
PROJECT_PRIORITY = {"go.mod": 0, "package.json": 10, "readme": 20, "tsconfig.json": 30, "makefile": 40, "dockerfile": 50, ".env.example": 60}
WITH_ENDING = ("readme", "dockerfile")


def unexpired(mutations: DataFrame, now: str) -> DataFrame:
    """mutations (state, expires_at, ...) with staged and published ones expired at `now`."""
    over = F.col("state").isin("staged", "published") & (F.col("expires_at") <= F.lit(now))
    return mutations.withColumn("state", F.when(over, "expired").otherwise(F.col("state")))


def classified(seen: DataFrame, mutations: DataFrame, now: str) -> DataFrame:
    """seen (path, present, content_hash, store_hash, store_revision) with mutation_id, matched and classification.

    Of a path's live published mutations the latest counts, by revision, time and id; a file is
    our own write where file and store both hold its hash and the store is no older.
    """
    live = unexpired(mutations, now).where("state = 'published'")
    latest = live.groupBy("path").agg(F.max(F.struct("revision", "published_at", "id", "hash")).alias("m"))
    own = F.col("present") & (F.col("content_hash") != "") & (F.col("content_hash") == F.col("m.hash")) & (F.col("store_hash") == F.col("m.hash")) & (F.col("store_revision") >= F.col("m.revision"))
    matched = F.coalesce(own, F.lit(False))
    kind = F.when(matched, "self_write_confirmed").when(~F.col("present"), "removed").when(F.col("m").isNull(), "unchanged").otherwise("external_change")
    return seen.join(latest, "path", "left").select(*seen.columns, F.col("m.id").alias("mutation_id"), matched.alias("matched"), kind.alias("classification"))


def heads(events: DataFrame, snapshot: str, most_bytes: int) -> DataFrame:
    """Head of each artifact after publishing and failing in order of seq, from events (key, seq, kind, id, input_snapshot, payload, error).

    A publication counts where it has a payload of at most `most_bytes` and was made from the
    current snapshot; a failure keeps the current version and leaves its error until the next
    publication. One aggregation with partial sums; no events are gathered.
    """
    bytes_ = F.octet_length("payload")
    ok = (F.col("kind") == "publish") & (F.col("input_snapshot") == snapshot) & (bytes_ > 0) & (bytes_ <= most_bytes)
    bad = F.col("kind") == "failure"
    found = events.where(ok | bad).groupBy("key").agg(
        F.count_if(ok).alias("latest_revision"), F.max_by("id", F.when(ok, F.col("seq"))).alias("current"), F.max(F.when(ok, F.col("seq"))).alias("published"),
        F.max(F.when(bad, F.col("seq"))).alias("failed"), F.max_by("error", F.when(bad, F.col("seq"))).alias("error"),
    )
    pending = F.col("failed").isNotNull() & (F.col("published").isNull() | (F.col("failed") > F.col("published")))
    status = F.when(F.col("latest_revision") > 0, "current").otherwise("failed")
    return found.select("key", "latest_revision", F.when(F.col("latest_revision") > 0, F.col("current")).alias("current"), status.alias("status"), F.when(pending, F.col("error")).otherwise("").alias("last_error"))


def evaluated(artifacts: DataFrame, dependencies: DataFrame, symbols: DataFrame, now: dict[str, str]) -> DataFrame:
    """(id, status, reasons): whether artifacts (id, status, prompt, provider, model) still hold, reasons in order.

    dependencies are (id, seq, kind, ref, hash), symbols (ref, current); `now` has prompt,
    provider, model and snapshot. Artifacts in the making and failed ones keep their status.
    """
    current = dependencies.join(symbols.select(F.col("ref"), F.col("current"), F.lit(True).alias("known")), "ref", "left")
    reason = (
        F.when((F.col("kind") == "snapshot") & (F.col("hash") != now["snapshot"]), "structural snapshot changed")
        .when((F.col("kind") == "symbol") & F.col("known").isNull(), F.concat(F.lit("dependency no longer exists: "), "ref"))
        .when((F.col("kind") == "symbol") & (F.col("current") != F.col("hash")), F.concat(F.lit("dependency content changed: "), "ref"))
    )
    broken = current.select("id", "seq", reason.alias("reason")).where("reason IS NOT NULL")
    broken = broken.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "reason"))), lambda x: x["reason"]).alias("broken"))
    prompt = F.when(F.col("prompt") != now["prompt"], "prompt version changed")
    model = F.when((F.col("provider") != now["provider"]) | (F.col("model") != now["model"]), "provider or model changed")
    kept = F.col("status").isin("generating", "failed")
    reasons = F.when(kept, F.array().cast("array<string>")).otherwise(F.concat(F.array_compact(F.array(prompt, model)), F.coalesce("broken", F.array().cast("array<string>"))))
    return artifacts.join(broken, "id", "left").withColumn("reasons", reasons).select("id", F.when(kept, F.col("status")).when(F.size("reasons") > 0, "stale").otherwise("current").alias("status"), "reasons")


def collection_status(runs: DataFrame, pages: DataFrame, expected: DataFrame) -> DataFrame:
    """runs (key, generating, error, published, snapshot) with the status of their pages (key, slug, hash) against expected ones."""
    same = pages.join(expected.select("key", "slug", F.col("hash").alias("expected")), ["key", "slug"], "left")
    counted = same.groupBy("key").agg(F.count("*").alias("pages"), F.count_if(~F.col("hash").eqNullSafe(F.col("expected"))).alias("changed"))
    stale = F.when(F.col("published") != "", F.col("published") != F.col("snapshot")).otherwise(F.col("changed") > 0)
    status = F.when(F.col("generating"), "generating").when(F.col("error") != "", "failed").when(F.col("pages").isNull(), "not_generated").when(stale, "stale").otherwise("ready")
    return runs.join(counted, "key", "left").select("key", status.alias("status"))


def symbol_name(title: Column) -> Column:
    """The last segment of a title's qualified name, before its dash."""
    return F.regexp_replace(F.split(title, " — ")[0], r"^(?s:.*)(?:::|[./])", "")


def case_metrics(cases: DataFrame, pack: DataFrame, relevant: DataFrame, forbidden: list[str]) -> DataFrame:
    """Metrics of each case (case_id, symbol, target, requested, used) over its evidence (case_id, id, symbol_id, title, path, kind).

    relevant are (case_id, name); forbidden are prefixes of paths, their trailing dots, stars and slashes cut.
    """
    named = pack.withColumn("name", symbol_name(F.col("title")))
    bad = [p.rstrip("./*") for p in forbidden]
    hits = reduce(lambda a, p: a + F.when(F.col("path").startswith(p), 1).otherwise(0), filter(None, bad), F.lit(0))
    whole = named.join(cases.select("case_id", "symbol", "target"), "case_id").groupBy("case_id").agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("distinct"), F.count_if(F.col("kind") == "").alias("unsourced"), F.sum(hits).alias("forbidden_hits"),
        F.bool_or((F.col("symbol_id") == F.col("target")) & (F.col("name") == F.col("symbol"))).alias("hit"),
    )
    present = named.select("case_id", "name", F.lit(1).alias("present")).distinct()
    recall = relevant.join(present, ["case_id", "name"], "left").groupBy("case_id").agg((F.count("present") / F.count("*")).alias("recall"))
    share = lambda x: F.coalesce(x / F.col("n"), F.lit(0.0))
    return cases.join(whole, "case_id", "left").join(recall, "case_id", "left").select(
        "case_id", F.coalesce("n", F.lit(0)).cast("long").alias("evidence"), (F.coalesce("hit", F.lit(False)) | (F.col("symbol") == "")).alias("target_resolved"),
        F.coalesce("recall", F.lit(1.0)).alias("recall"), F.coalesce("forbidden_hits", F.lit(0)).cast("long").alias("forbidden_hits"),
        share(F.col("n") - F.col("distinct")).alias("duplicate_rate"), share(F.col("unsourced")).alias("unsourced_rate"),
        F.when((F.col("requested") > 0) & (F.col("used") > F.col("requested")), 1).otherwise(0).cast("long").alias("over_budget"),
    )


def summary(metrics: DataFrame) -> DataFrame:
    """All cases in one row."""
    return metrics.agg(
        F.count("*").alias("cases"), F.avg(F.col("target_resolved").cast("int")).alias("resolution_rate"), F.avg("recall").alias("mean_recall"),
        F.sum("forbidden_hits").alias("forbidden_hits"), F.sum("over_budget").alias("over_budget"),
    )


def surface_scores(pages: DataFrame, sections: dict[str, str], code_expected: bool) -> DataFrame:
    """pages (id, markdown) with citation_density, structure, code_blocks, speculation and their weighted score of 100."""
    lines = F.filter(F.transform(F.split("markdown", "\n"), lambda x: F.regexp_replace(x, f"^{BLANK}+|{BLANK}+$", "")), lambda x: x.startswith("-") | x.startswith("*"))
    cited = F.size(F.filter(F.col("claims"), lambda x: x.contains("](")))
    density = F.when(F.size("claims") > 0, cited / F.size("claims")).otherwise(0.0)
    found = sum((F.col("markdown").contains(m).cast("int") for m in sections.values()), F.lit(0))
    structure = found / F.lit(len(sections)) if sections else F.lit(1.0)
    blocks = F.floor((F.size(F.split("markdown", "```")) - 1) / 2)
    guesses = sum((F.lower("markdown").contains(p).cast("int") for p in SPECULATION), F.lit(0))
    out = pages.withColumn("claims", lines).select("id", density.alias("citation_density"), structure.alias("structure"), blocks.cast("long").alias("code_blocks"), guesses.cast("long").alias("speculation"))
    code = F.when(F.lit(code_expected) & (F.col("code_blocks") == 0), 0.0).otherwise(1.0)
    return out.withColumn("score", F.round(100 * (0.3 * F.col("citation_density") + 0.5 * F.col("structure") + 0.1 * code + 0.1 * F.when(F.col("speculation") > 0, 0.0).otherwise(1.0)), 2))


def page_paths(pages: DataFrame) -> DataFrame:
    """pages (slug, parent) with `at`, their slugs from the root down: in its order, each page comes before its children.

    The overview and its children come first, then other roots; parents that are missing, or the
    page itself, count as none. Pages that are each other's ancestors come last: of such a chain
    the page with the smallest slug begins, and the link to its own parent is left out. Each round
    joins every page with what its furthest known ancestor knows, so that a hierarchy of any
    depth takes as many rounds as its depth has binary digits.
    """
    real = pages.join(pages.select(F.col("slug").alias("parent")).distinct(), "parent", "left_semi").where("parent <> slug").select("slug", F.col("parent").alias("above"))
    linked = pages.select("slug").join(real, "slug", "left")
    # the smallest slug among a page and its ancestors; a page whose ancestors never end lies in or under a circle
    known, span, before = cut(linked.withColumn("least", F.col("slug"))), 1, -1
    while True:
        open_ = known.where("above IS NOT NULL").count()
        if not open_ or (open_ == before and span > open_):
            break
        further = known.select(F.col("slug").alias("above"), F.col("above").alias("next"), F.col("least").alias("other"))
        known = cut(known.join(further, "above", "left").select("slug", F.col("next").alias("above"), F.least("least", "other").alias("least")))
        span, before = 2 * span, open_
    circling = known.where("above IS NOT NULL").select("slug", (F.col("least") == F.col("slug")).alias("begins"))
    tree = cut(linked.join(circling, "slug", "left").select("slug", F.when(~F.coalesce("begins", F.lit(False)), F.col("above")).alias("above"), F.col("begins").isNotNull().alias("late"), F.array("slug").alias("at")))
    while not tree.where("above IS NOT NULL").isEmpty():
        further = tree.select(F.col("slug").alias("above"), F.col("above").alias("next"), F.col("at").alias("head"))
        at = F.when(F.col("head").isNotNull(), F.concat("head", "at")).otherwise(F.col("at"))
        tree = cut(tree.join(further, "above", "left").select("slug", F.col("next").alias("above"), "late", at.alias("at")))
    group = F.when(F.col("late"), "2").when(F.col("at")[0] == "overview", "0").otherwise("1")
    return pages.join(tree.select("slug", F.concat(F.array(group), "at").alias("at")), "slug")


def accepted_diagnostics(facts: DataFrame, document: dict) -> DataFrame:
    """facts with `accepted`: diagnostics of exactly this document, version, content, session and path."""
    same = reduce(lambda a, x: a & F.col(x[0]).eqNullSafe(F.lit(x[1])), document.items(), F.col("kind") == "diagnostic")
    return facts.withColumn("accepted", same & F.lit(document["session"] != ""))


def severity_rank(severity: Column) -> Column:
    return reduce(lambda w, x: w.when(severity == x[1], x[0]), enumerate(SEVERITIES), F.when(F.lit(False), 0)).otherwise(len(SEVERITIES))


def see_also(pack: DataFrame, symbols: DataFrame, target: int, limit: int) -> DataFrame:
    """Other symbols (symbol_id, name, path, priority, relevance) of a pack (seq, symbol_id, path, kind, relation, relevance) worth a look."""
    ok = (F.col("symbol_id") != target) & (F.col("kind") != "test") & (F.col("relation") != "usage_site") & (F.col("path") != "")
    first = pack.where(ok).groupBy("symbol_id").agg(F.min_by(F.struct("path", "relevance"), "seq").alias("e"))
    rows = first.join(symbols.where("symbol_kind NOT IN ('file', 'import', 'test')"), "symbol_id")
    k, name = F.col("symbol_kind"), F.col("name")
    priority = F.when(k == "interface", 0).when(k.isin("type", "class"), 1).when((k == "function") & name.startswith("New"), 2).when(k == "method", 3).otherwise(4)
    rows = rows.select("symbol_id", "name", F.col("e.path").alias("path"), priority.alias("priority"), F.col("e.relevance").alias("relevance"))
    return rows.orderBy("priority", F.desc("relevance"), "name", "path", "symbol_id").limit(limit)


def project_priority(path: Column) -> Column:
    name = F.lower(base_name(path))
    hit = lambda k: (name == k) | (name.startswith(k + ".") if k in WITH_ENDING else F.lit(False))
    return reduce(lambda w, x: w.when(hit(x[0]), x[1]), PROJECT_PRIORITY.items(), F.when(F.lit(False), 0)).otherwise(100)


def change_counts(changes: DataFrame, most: int = 200) -> DataFrame:
    """One row from changes (path, change): counts by change, and whether changed_paths leaves any out."""
    kinds = [F.count_if(F.col("change") == k).alias(k) for k in ("added", "changed", "removed")]
    return changes.agg(*kinds, F.count("*").alias("total"), (F.count("*") > most).alias("truncated"))


def changed_paths(changes: DataFrame, most: int = 200) -> DataFrame:
    return changes.select("path").orderBy("path").limit(most)


def missing_vectors(symbols: DataFrame, vectors: DataFrame) -> DataFrame:
    """Symbols (id, kind) other than files that have no vector (id) yet."""
    return symbols.where("kind <> 'file'").join(vectors.select("id"), "id", "left_anti")
