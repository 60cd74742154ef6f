"""Code maps and summaries: external nodes, call flows, traces, modules, trees and source hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.symbols import external_kind
from tessera.operators import graph
from tessera.operators.lineage import cut
from tessera.operators.snapshot import running_digests

#: Nodes of a map: as many by default, at least and at most; of them for what lies outside, at most.
NODES, FEWEST, MOST, OUTSIDE = 36, 8, 60, 4


def with_imports(edges: DataFrame, imports: DataFrame) -> DataFrame:
    """Unresolved edges with `external`: what the receiver of a call is imported as in its file decides."""
    receiver = F.when(F.col("to_name").contains("."), F.split("to_name", r"\.")[0])
    joined = edges.withColumn("alias", receiver).join(imports.select("path", "alias", "import_path"), ["path", "alias"], "left")
    return joined.withColumn("external", external_kind(F.col("kind"), F.col("to_name"), F.col("language"), F.col("import_path"))).drop("alias")


def flow_roots(nodes: DataFrame, edges: DataFrame, most: int = 4) -> DataFrame:
    """Where flows begin: callers that nothing calls, or else all callers; by entry score, relevance and label.

    nodes: id, label, kind, path, relevance; edges: src, dst, kind. Only calls between nodes that
    have a path count; tests never begin a flow.
    """
    calls = _local_calls(nodes, edges)
    callers = nodes.where("path <> '' AND kind <> 'test'").join(calls.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
    called = calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("incoming"))
    roots = callers.join(called, "id", "left").withColumn("incoming", F.coalesce("incoming", F.lit(0)))
    is_root = (F.col("incoming") == 0) & ~F.col("kind").isin("file", "import")
    any_root = roots.agg(F.coalesce(F.max(is_root), F.lit(False)).alias("any"))
    low = F.lower("label")
    points = F.when((low == "main") | low.startswith("bootstrap"), 100).when(low.isin("create", "handle") | low.contains("handler"), 90).otherwise(50)
    chosen = roots.crossJoin(F.broadcast(any_root)).where(is_root | ~F.col("any"))  # any_root is one row
    return chosen.withColumn("points", points).orderBy(F.desc("points"), F.desc("relevance"), "label", "id").limit(most).drop("any")


def _local_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls between nodes that have a path."""
    local = nodes.where("path <> ''").select("id")
    return edges.where("kind = 'calls'").join(local.withColumnRenamed("id", "src"), "src", "left_semi").join(local.withColumnRenamed("id", "dst"), "dst", "left_semi")


def call_flows(roots: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """(flow, step, id): each root's walk over calls, breadth first, `most` nodes at most; root is step 0.

    roots: flow, id; nodes: id, label, path; edges: src, dst, kind, line, seq. All roots walk at
    once: a round joins the frontiers with the calls; of the nodes that a flow meets for the
    first time, those come first whose caller did, then by line, label and seq of the call. A
    frontier has no more than `most` rows for each root, and there are no more rounds than that.
    """
    labels = nodes.select(F.col("id").alias("dst"), "label")
    at = F.min(F.struct("line", "label", "seq")).alias("at")
    calls = cut(_local_calls(nodes, edges).join(labels, "dst").groupBy("src", "dst").agg(at))
    frontier = roots.select("flow", "id", F.lit(0).alias("step"))
    seen = frontier
    for _ in range(most - 1):
        met = frontier.join(calls, frontier["id"] == calls["src"]).groupBy("flow", F.col("dst").alias("id")).agg(F.min(F.struct("step", "at")).alias("first"))
        new = met.join(seen.select("flow", "id"), ["flow", "id"], "left_anti")
        taken = seen.groupBy("flow").agg(F.count("*").cast("int").alias("taken"))
        place = F.row_number().over(Window.partitionBy("flow").orderBy("first")) - 1
        frontier = cut(new.withColumn("place", place).where(F.col("place") < most).join(taken, "flow").select("flow", "id", (F.col("taken") + F.col("place")).alias("step")).where(F.col("step") < most))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def flow_steps(flows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Flows with the path and line of each step: of the call by the nearest step before it, else its own.

    Of several calls between two nodes the most confident counts, then the one of the smallest line.
    nodes: id, label, path, start_line; edges: src, dst, kind, path, line, confidence.
    """
    best = F.min(F.struct((-F.col("confidence")).alias("doubt"), "line", "path"))
    pairs = edges.where("kind = 'calls' AND src <> dst").groupBy("src", "dst").agg(best.alias("call"))
    earlier = flows.select("flow", F.col("id").alias("src"), F.col("step").alias("before"))
    via = earlier.join(flows.select("flow", F.col("id").alias("dst"), "step"), "flow").where("before < step").join(pairs, ["src", "dst"])
    nearest = via.groupBy("flow", "step").agg(F.max(F.struct("before", "call")).alias("via"))
    own = flows.join(nodes.select("id", "label", F.col("path").alias("own_path"), "start_line"), "id").join(nearest, ["flow", "step"], "left")
    return own.select("flow", "step", "id", "label", F.col("via.before").alias("caller_step"), F.coalesce("via.call.path", "own_path").alias("path"), F.coalesce("via.call.line", "start_line").alias("line"))


def node_limit(asked: int = 0) -> int:
    return NODES if not asked else min(max(asked, FEWEST), MOST)


def code_map(symbols: DataFrame, edges: DataFrame, imports: DataFrame, seeds: list[tuple], asked: int = 0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a map around seeds (id, relevance), their number limited.

    Symbols two steps around the seeds, in order of the edges, leave room for a few nodes outside;
    edges among them and unresolved ones stay. What an unresolved edge points at is a node too, by
    its first edge while there is room: packages of imports and receivers, named in their files;
    builtins are none. nodes: place, id, label, kind, path, relevance; edges: seq, source, target,
    kind, path, line. Both are a map's few rows. symbols: id, name, kind, path, language; edges:
    seq, src, dst, to_name, kind, path, line, confidence.
    """
    most = node_limit(asked)
    inside = max(6, most - min(OUTSIDE, most // 6))
    known = symbols.select(F.col("id").alias("dst"))
    real = edges.where("dst IS NULL").unionByName(edges.where("dst IS NOT NULL").join(known, "dst", "left_semi").select(*edges.columns))
    indexed = real.withColumn("idx", F.col("seq"))
    around = cut(graph.neighbourhood(indexed, [s for s, _ in seeds], 2, inside))
    kept = graph.induced(indexed, around).select(F.col("idx").alias("seq"))
    own = real.join(F.broadcast(around.select(F.col("node").alias("src"))), "src", "left_semi").join(kept, "seq", "left_semi")
    language = F.broadcast(around).join(symbols.select(F.col("id").alias("node"), "language"), "node").select(F.col("node").alias("src"), "language")
    open_ = with_imports(own.where("dst IS NULL").join(language, "src"), imports)
    named = F.trim(F.when((F.col("language") == "go") & (F.col("kind") != "imports"), F.col("import_path")).otherwise(F.col("to_name")))
    outside = open_.where("external IN ('stdlib', 'external')").withColumn("label", named).where("label <> ''")
    outside = outside.withColumn("target", F.concat(F.lit("external-"), F.substring(F.sha2(F.concat("external", F.lit(":"), "label"), 256), 1, 16)))
    first = outside.groupBy("target").agg(F.min("seq").alias("first"), F.first("label").alias("label"), F.first("external").alias("kind"))
    count = around.agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy("first"))  # what few nodes point at
    admitted = first.withColumn("r", place).crossJoin(F.broadcast(count)).where(F.col("r") + F.col("n") <= most)
    relevance = F.broadcast(edges.sparkSession.createDataFrame([(s, float(r)) for s, r in seeds], f"node {symbols.schema['id'].dataType.simpleString()}, relevance double"))
    local = F.broadcast(around).join(symbols, F.col("node") == F.col("id")).join(relevance, "node", "left")
    nodes = local.select(F.col("id").cast("string").alias("id"), F.col("name").alias("label"), "kind", "path", F.coalesce("relevance", F.lit(0.0)).alias("relevance"))
    nodes = nodes.unionByName(admitted.select(F.col("target").alias("id"), "label", "kind", F.lit("").alias("path"), F.when(F.col("kind") == "stdlib", 0.15).otherwise(0.2).alias("relevance")))
    nodes = nodes.withColumn("place", F.row_number().over(Window.orderBy(F.desc("relevance"), "label", "id")))  # the map's nodes
    linked = own.where("dst IS NOT NULL").select("seq", F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"), "kind", "path", "line")
    linked = linked.unionByName(outside.join(F.broadcast(admitted.select("target")), "target", "left_semi").select("seq", F.col("src").cast("string").alias("source"), "target", "kind", "path", "line"))
    return nodes, linked


def trace(edges: DataFrame, labels: DataFrame, most: int = 12) -> DataFrame:
    """(seq, step): distinct steps between labelled nodes, calls first, then what contains, then imports."""
    name = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    named = edges.join(name("src"), "src", "left").join(name("dst"), "dst", "left")
    step = F.concat(F.coalesce("src_label", F.lit("")), F.lit(" —"), "kind", F.lit("→ "), F.coalesce("dst_label", F.lit("")))
    priority = F.when(F.col("kind") == "contains", 1).when(F.col("kind") == "imports", 2).otherwise(0)
    first = named.select(step.alias("step"), F.struct(priority.alias("priority"), "seq").alias("at")).groupBy("step").agg(F.min("at").alias("at"))
    return first.orderBy("at").limit(most).select("at.priority", "at.seq", "step")


def modules(symbols: DataFrame, module: Column) -> DataFrame:
    """One row for each module: its distinct paths, files, symbols and first language."""
    rows = symbols.withColumn("module", module).where("module <> ''")
    first = F.min_by("language", F.when(F.col("language") != "", F.col("id")))
    is_file = (F.col("kind") == "file").cast("long")
    return rows.groupBy("module").agg(F.count_distinct("path").alias("paths"), F.sum(is_file).alias("files"), F.sum(1 - is_file).alias("symbols"), first.alias("language"))


def tree(paths: DataFrame) -> DataFrame:
    """(parent, name, type, seq) of every node of the file tree: directories before files, by name."""
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(
        F.array_join(F.slice(parts, F.lit(1), i - 1), "/").alias("parent"), F.element_at(parts, i).alias("name"), F.when(i < F.size(parts), "directory").otherwise("file").alias("type")))
    nodes = paths.select(F.inline(steps)).distinct()
    return nodes.withColumn("seq", F.row_number().over(Window.partitionBy("parent").orderBy("type", "name")))


def page_parts(symbols: DataFrame, files: DataFrame, edges: DataFrame, by: str, versions: list[str] = ()) -> DataFrame:
    """(by, part): what a page's source hash covers: its files, symbols, the edges from or to these, and the versions of whatever makes pages.

    symbols: by, id, signature; files: by, path, hash; edges: seq, src, dst, kind, to_name.
    """
    line = F.concat_ws(":", F.col("src").cast("string"), "kind", F.coalesce("to_name", F.lit(""))).alias("part")
    at = lambda end: edges.join(symbols.select(by, F.col("id").alias(end)), end).select(by, "seq", line)
    from_symbols = at("src").unionByName(at("dst")).distinct().select(by, "part")
    rows = symbols.select(by, F.concat(F.col("id").cast("string"), "signature").alias("part")).unionByName(files.select(by, F.concat(F.lit("file:"), "path", F.lit(":"), "hash").alias("part"))).unionByName(from_symbols)
    scopes = symbols.select(by).unionByName(files.select(by)).distinct()
    return rows.unionByName(scopes.select(by, F.explode(F.array(*[F.lit(v) for v in versions])).alias("part"))) if versions else rows


def source_hashes(parts: DataFrame, by: str) -> DataFrame:
    """(by, hash): the first 12 bytes of the hash over a scope's parts in order, one in a line.

    The parts stream through a running hash, so that a scope of any size takes no memory.
    """
    rows = parts.select(by, "part").repartition(F.col(by)).sortWithinPartitions(by, "part")
    return running_digests(rows, "parts", b"\n").select(by, F.substring("digest", 1, 24).alias("hash"))


def snippets(edges: DataFrame, code: DataFrame) -> DataFrame:
    """Edges with the line of their source's code on which they lie."""
    lines = F.split("code", "\n")
    joined = edges.join(code.select(F.col("id").alias("src"), "code", "start_line"), "src")
    at = F.col("line") - F.col("start_line") + 1
    return joined.withColumn("snippet", F.when(at.between(1, F.size(lines)), F.trim(F.try_element_at(lines, at.cast("int"))))).drop("code", "start_line")
